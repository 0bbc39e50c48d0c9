"""op3: forward-backward against enumeration, held-out accuracy, odd rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.language import tokens, Crf, fit, identify, label_words, op3_language_id, train


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    words = ["ab", "cd", "ab", "xyz"]
    model = train([(["ab", "xyz"], [0, 1]), (["cd", "cd"], [1, 1]), (["ab", "cd"], [0, 1])], ["p", "q"], epochs=2, lexicon_min=1)
    model.trans, model.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    got = model.marginals([words, ["cd"]])
    for ws, m in zip([words, ["cd"]], got, strict=True):
        total, sums = 0.0, np.zeros((len(ws), 2))
        for path in itertools.product(range(2), repeat=len(ws)):
            s = model.start[path[0]] + sum(model.emission(w)[y] for w, y in zip(ws, path, strict=True))
            s += sum(model.trans[a, b] for a, b in zip(path, path[1:], strict=False))
            total += np.exp(s)
            for i, y in enumerate(path):
                sums[i, y] += np.exp(s)
        assert np.allclose(m, sums / total, atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_code_switch(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, per_label=100)
    a, b = (docs.where((F.col("lang") == x) & (F.length("text") > 300)).orderBy("doc_id").first().text.split()[:12] for x in model.labels[:2])
    mixed = spark.createDataFrame([(1, " ".join(a + b)), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.words for r in label_words(mixed, model).collect()}
    langs = [w.lang for w in rows[1]]
    right = sum(x == model.labels[0] for x in langs[:8]) + sum(x == model.labels[1] for x in langs[-8:])
    assert right >= 13
    assert rows[2] is None and rows[3] == []


def test_odd_rows(odd_docs, no_docs):
    model = fit(odd_docs, per_label=5)
    rows = identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not (r.text or "").strip())
    empty = fit(no_docs)
    assert isinstance(empty, Crf) and empty.labels == []
    assert {r.lang_pred for r in identify(odd_docs, empty).collect()} == {"und"}
    assert identify(no_docs, model).count() == 0
    words = label_words(odd_docs, empty).select("text", "words").collect()
    assert all((r.words is None) == (r.text is None) for r in words)
    assert {w.lang for r in words for w in r.words or []} == {"und"}


def test_signs_that_are_no_letters(spark, sf):
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"), per_label=20)
    rows = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 _"), (2, "x½y")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] != "und"
    assert tokens("Straße½x² 中文 ábc1d") == ["straße", "x", "中文", "ábc", "d"]
