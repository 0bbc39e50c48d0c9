"""op1: base counts against plain Python, cutoffs against exact binomial sums."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from foliant.llm.quality import LADDERS, apply_rules, binomial_cdf, cutoffs, op1_quality_rules, signals


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_base_counts(spark, sf):
    rows = op1_quality_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(odd_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    got = apply_rules(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])


def test_empty(no_docs, spark):
    assert apply_rules(no_docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_binomial(spark):
    cases = [(0, 100, 0.005), (3, 700, 0.005), (10, 5000, 0.005), (7, 7, 0.3)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for p in {c[2] for c in cases}:
        for r in df.withColumn("p", binomial_cdf(F.col("k"), F.col("n"), p)).collect():
            exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert math.isclose(r.p, min(1.0, exact), rel_tol=1e-9)


def test_cutoffs_hold_the_risk(spark):
    """The strictest cutoff certified is one whose exact bound holds, and the next fails."""
    n = 4000
    rows = [(i, "good words in a row here are ten of them " + "#" * (i % 400 == 0) * 12, "en") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    scored = signals(docs)
    got = cutoffs(scored, labels, "lang", alpha=0.04, delta=0.05).first().asDict()
    share, level = 0.04 / len(LADDERS), 0.05 / len(LADDERS)
    values = [r[0] for r in scored.where("NOT base_failed").select("symbol_share").collect()]
    best = None
    for c in LADDERS["symbol_share"]:
        k = sum(v > c for v in values)
        p = sum(math.comb(len(values), i) * share**i * (1 - share) ** (len(values) - i) for i in range(k + 1))
        if p > level:
            break
        best = c
    assert best is not None and got["cut_symbol_share"] == best


def test_no_labels_reject_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = apply_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert got.where("kept = base_failed").count() == 0


def test_certified_cutoffs_reject(spark):
    """Where the labels certify a cutoff, documents beyond it go, and no stratum loses more good ones than alpha allows."""
    rows = [(i, "good words in a row here are ten of them " + "#" * (12 * (i % 400 == 0)), ("en", "pt")[i % 2]) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = apply_rules(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    gone = {r.doc_id for r in got.where("NOT kept AND NOT base_failed").collect()}
    by = {k: sum(i % 2 == k for i in gone) for k in (0, 1)}
    assert all(v <= 0.01 * 4000 for v in by.values())
    rare = spark.createDataFrame([(i, t if i % 4000 else t + "#" * 12, x) for i, t, x in ((i, "good words in a row here are ten of them ", "en") for i in range(8000))], "doc_id long, text string, lang string")
    got = apply_rules(rare, rare.select("doc_id", F.lit(1).alias("quality")))
    assert {r.doc_id for r in got.where("NOT kept AND NOT base_failed").collect()} == {0, 4000}
