"""op2: targets against a water-filling loop, taken words against targets."""

from __future__ import annotations

import re

from foliant.llm.mixing import mix, op2_source_mix


def filled(sizes, weights, share=1.5, cap=2.0):
    left, out, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def check(rows):
    sizes, first = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        first[r.source] = r
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(0.02 * want[s], max(r.size for r in mine))
    assert all(r.size == 0 or (r.taken % r.size == 0 and r.taken <= 2 * r.size) for r in rows)


def test_targets_and_copies(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_source_mix(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")) for r in rows)
    check(rows)


def test_reruns_agree(spark, sf):
    a, b = (sorted(map(tuple, op2_source_mix(spark, sf).select("doc_id", "taken").collect())) for _ in range(2))
    assert a == b


def test_rank_follows_inclusion_odds(spark):
    """Long documents have the greater odds; fixed size in words is met."""
    rows = [(i, "w " * (400 if i % 2 else 4), "en", "s" if i < 3000 else "t") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, weights=(1.0, 5.0)).collect()
    s = [r for r in got if r.source == "s"]
    mean = lambda big: sum(r.copies for r in s if (r.size > 100) == big) / sum((r.size > 100) == big for r in s)
    assert mean(True) > mean(False)
    assert abs(sum(r.copies * r.size for r in s) - s[0].target) <= 400


def test_odd_rows(odd_docs, no_docs):
    got = mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.copies <= 2 and (r.size or r.copies == 0) for r in got)
    assert mix(no_docs).count() == 0
