"""Steps that must grow with the input: fast forms against plain ones, and their bounds."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from foliant.functions import distance as D
from foliant.functions import report as R


def garbled(rng, text, letters):
    out = list(text)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = [rng.choice(letters)] * rng.randrange(3)
    return "".join(out)


def long_pair(n=20_000):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    ref = "".join(w.capitalize() + ".\n" if i % 40 == 39 else f"the{w} " for i, w in enumerate(words))
    return ref.replace("th", "d"), ref


def test_edits_equal_the_whole_comparison():
    rng = random.Random(8)
    for _ in range(3000):
        letters = rng.choice(["ab \n", "thd \n", "abcdefg  \n- "])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        b = garbled(rng, a, letters) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert D.edits(a, b) == D.levenshtein_seq(a, b)
        assert D.word_edits(a, b) == D.edit_ops(a.split(), b.split())


def test_edits_of_long_texts_are_linear():
    hyp, ref = long_pair()
    began, n = time.perf_counter(), ref.count("th")
    assert D.edits(hyp, ref) == 2 * n
    assert sum(D.word_edits(hyp, ref)) == sum("th" in w for w in ref.split())
    assert time.perf_counter() - began < 3


def test_page_counters_use_whole_texts():
    """An error after the 3,000th word, and blocks after the 1,000th."""
    ref = " ".join(f"w{i}" for i in range(4000))
    c = R.text_counters(ref.replace("w3900", "x y"), ref)
    assert (c["word_edits"], c["substitutions"], c["deletions"], c["insertions"]) == (2, 1, 1, 0)
    blocks = "\n\n".join(f"p{i}" for i in range(1500))
    assert R.structure(blocks + "\n\n# h", blocks)["markdown_ast_similarity"] == round(1500 / 1501, 4)


def test_ratio_is_that_of_difflib():
    rng = random.Random(9)
    for _ in range(150):
        letters = rng.choice(["abcdefgh \n", "abcdefghijklmnopqrstuvwxyzABCDEF0123", "".join(map(chr, range(200, 320)))])
        weights = [rng.random() ** 3 for _ in letters]
        a = "".join(rng.choices(letters, weights, k=rng.choice([0, 30, 199, 200, 205, 600])))
        b = garbled(rng, a, letters) if rng.random() < 0.8 else "".join(rng.choices(letters, weights, k=300))
        assert D.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_ratio_of_long_texts_is_linear():
    hyp, ref = long_pair()
    began = time.perf_counter()
    assert 0 < D.ratio(ref, hyp) < 1
    assert time.perf_counter() - began < 5


def test_union_area_makes_no_rows_of_slabs(spark):
    """Against counted unit squares, and without a join or a row per slab and box."""
    from foliant.operators import spatial as S

    rng = random.Random(10)
    boxes = [(p, *(float(v) for v in (x, y, x + rng.randrange(9), y + rng.randrange(9)))) for p in range(4) for x, y in [(rng.randrange(30), rng.randrange(30)) for _ in range(80)]]
    want = {p: len({(x, y) for q, x0, y0, x1, y1 in boxes if q == p for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}) for p in range(4)}
    got = S.union_area(spark.createDataFrame(boxes, "pg int, x0 double, y0 double, x1 double, y1 double"), ["pg"])
    assert {r.pg: r.union_area for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    import numpy as np

    one = np.array([b[1:] for b in boxes if b[0] == 0 and b[3] > b[1] and b[4] > b[2]])
    assert S.covered(one) == S.covered(one, block=100) == want[0]


def test_texts_travel_in_small_batches(spark, sf):
    from foliant.plans import base

    base.table(spark, sf, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_repeats_of_a_page_by_all_pairs():
    from foliant.operators.layout import Box, iou
    from foliant.plans.evidence import repeats_of_page

    rng = random.Random(11)
    for _ in range(30):
        bids, texts = [rng.randrange(40) for _ in range(50)], [rng.choice(["a", "A ", "b\t c", "b c"]) for _ in range(50)]
        boxes = [Box(x, y, x + 4.0, y + 4.0) for x, y in ((rng.randrange(3) * 0.5, rng.randrange(3) * 0.5) for _ in range(50))]
        key = [" ".join(t.casefold().split()) for t in texts]
        want = {bids[i] for i in range(50) for j in range(50) if bids[i] < bids[j] and key[i] == key[j] and iou(boxes[i], boxes[j]) >= 0.7}
        assert repeats_of_page(bids, texts, boxes) == len(want)


def test_footnotes_at_the_edge_of_their_share(spark, tmp_path):
    """750 * 0.68 is above 510 as a double; a line at 510 is in the lower part."""
    import datetime

    from foliant import plans

    row = (600, 1, 510, 2, 10.0, 1.0, 0.01, 0.01, "N", "O", datetime.datetime(2000, 1, 1))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(*row[:1], k, *row[2:]) for k in range(1, 7)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.bid: r.role for r in plans.QUERIES["p12_p13_line_roles"](spark, str(tmp_path)).collect()}
    assert got[6006] == "footnote"  # Fonte


def test_tracks_round_as_sql(spark, tmp_path):
    """Texts of 3 or 4 words whose confidence lies on an edge of the sixth digit."""
    import duckdb

    from foliant import plans

    rng = random.Random(12)
    rows = []
    for conv in range(1500):
        bare, ends = rng.choice([0, 1, 2, 3]), rng.randrange(33)
        for turn in range(32):
            words = ["a", "b", "c", rng.choice("d1")][: 3 if turn < bare else 4]
            rows.append((conv, turn, "user", " ".join(words) + ("." if turn < ends else "") + ("\n" if turn == 31 else "")))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = plans.QUERIES["a28_text_tracks"](spark, str(tmp_path))
    want = {r[0]: r for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES['a28_text_tracks']})").fetchall()}
    assert {r[0]: tuple(r) for r in df.collect()} == want


def test_precedences_are_those_of_pairs():
    from foliant.operators import layout as L

    rng = random.Random(13)
    kinds = [*L.PRIORITY, "odd"]
    for _ in range(12):
        rs = [L.Region(f"r{i}", rng.choice(kinds), L.Box(x := rng.randrange(500) * 0.7, y := rng.randrange(700) * 0.7, x + rng.randrange(200) - 5.0, y + rng.randrange(40) - 1.0), rng.choice([None, rng.randrange(99)])) for i in range(25)]
        c = rng.choice([None, 0.5])
        p = L.precedences(rs, c)
        assert all(p[i, j] == L.precedence(rs[i], rs[j], c) for i in range(25) for j in range(i + 1, 25))


def test_near_boxes_are_those_that_share_an_area():
    from foliant.operators.layout import Box, shared
    from foliant.operators.readings import Near

    rng = random.Random(14)
    boxes = [Box(x := rng.randrange(50), y := rng.randrange(50), x + rng.randrange(-2, 15), y + rng.randrange(-2, 15)) for _ in range(60)]
    near = Near(60)
    for i, b in enumerate(boxes):
        near.put(i, b)
    assert all(near.of(b) == [i for i, a in enumerate(boxes) if shared(a, b) > 0] for b in boxes)


def test_pages_are_not_gathered_in_one_task(spark, sf):
    """Adaptive execution joins small partitions, however long their pages take."""
    from foliant import plans

    for name in ("j15_fused_candidates", "k18_order_is_permutation", "k03_k12_rows_and_rules", "j25_d27_repeats"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan


def test_cells_come_back_from_the_first_shortest_run():
    from foliant.plans import critical as C

    rng = random.Random(15)
    for _ in range(60):
        words = [rng.choice(["a", "B", "ab", "b a", "ß", "ss"]) for _ in range(rng.randrange(20))]
        cells = [rng.choice(["a", "ab", "AB", "aba", "ssa", "baab", "zz"]) for _ in range(4)]
        most = max((len(C.compact(c)) for c in cells if len(C.compact(c)) >= 2), default=0)
        want = {}
        for c in set(cells):
            for n in range(12, 0, -1):
                for at in range(len(words) - n, -1, -1):
                    run = words[at : at + n]
                    if len(C.compact(c)) >= 2 and C.compact(" ".join(run)) == C.compact(c) and sum(map(len, run)) <= most:
                        want[c] = (" ".join(run), n, at)
        assert {c: (r, n, at) for c, r, n, at in C.runs_of_cells(words, list(set(cells)))} == want


def test_runs_and_characters_are_no_rows(spark, sf):
    from foliant import plans

    for name in ("f28_cell_recovery", "d02_reconstruct_lines"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan


def test_parts_get_few_pages_at_once(spark):
    import pandas as pd

    from foliant import plugins

    count = plugins.Plugin("count", "detector", lambda b: pd.DataFrame({"doc_id": b["doc_id"], "page_index": 0, "kind": str(len(b))}))
    pages = spark.range(200).select(F.col("id").alias("doc_id")).coalesce(1)
    got = count.apply(pages).collect()
    assert sorted(r.doc_id for r in got) == list(range(200)) and max(int(r.kind) for r in got) <= plugins.PAGES
