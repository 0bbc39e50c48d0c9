"""op10: the SQL twin, the threshold walk against full scans, odd vectors."""

from __future__ import annotations

import numpy as np

from foliant.llm.queries import ORACLES
from foliant.llm.top_k import Lists, op10_top_k, top_k


def test_sql(spark, sf, same_rows):
    same_rows(op10_top_k(spark, sf), ORACLES["op10_top_k"])


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (5000, 6))
    x[:, 0] *= 20
    lists = Lists(np.arange(5000), x)
    saved = 0
    for own in range(0, 5000, 250):
        q = x[own] * np.array([5, 1, 1, 0, 0, 0])
        ids, scores, seen = lists.search(q, own, 10)
        s = x @ q
        order = [i for i in np.lexsort((np.arange(5000), -s)) if i != own][:10]
        assert ids.tolist() == order and scores.tolist() == s[order].tolist()
        saved += seen < 5000
    assert saved > 10


def test_ties_blocks_and_odd_rows(spark):
    vec = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.5, 0.25], [0.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [3.0], []]
    rows = [(i, v, "x") for i, v in enumerate(vec)] + [(None, [1.0, 1.0], "x"), (1, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = top_k(df.where("vec_id in (0, 3, 9)"), df, k=3, block_rows=2, query_rows=1).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(1, 4096), (1, 4096), (2, 4096)]  # a repeated row counts, ties go to smaller ids
    assert by[3] == [(0, 2048), (1, 2048), (1, 2048)]
    assert 9 not in by
    assert top_k(df.where("false"), df).count() == 0 and top_k(df, df.where("false")).count() == 0
