"""Golden cases of tables, frames and fragments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant import settings
from foliant.functions import frames as R
from foliant.functions import geometry as G
from foliant.operators import fragments as P
from foliant.operators import tables as X


def part(no, text, x0, y0, x1, y1):
    return {"token_no": no, "text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def test_cell_text():
    words = [part(1, "world", 40, 0, 70, 10), part(0, "hello", 0, 0, 30, 10)]
    assert P.cell_text(words) == "hello world"
    assert P.cell_text([part(0, "Cód", 0, 0, 30, 10), part(1, "igo", 31, 0, 60, 10)]) == "Código"
    assert P.cell_text([part(0, "pre-", 0, 0, 30, 10), part(1, "fix", 40, 0, 60, 10)]) == "pre-fix"
    glyphs = [part(0, "a", 0, 0, 5, 10), part(1, "b", 6, 1, 11, 11), part(2, "c", 20, 0, 25, 10), part(3, "d", 0, 20, 5, 30)]
    assert P.cell_text(glyphs) == "ab c d" and P.native_text(glyphs[:3]) == "abc"
    assert P.cell_text([]) == "" and P.cell_text([part(0, " ", 0, 0, 5, 10)]) == ""


def region(n, x0, y0, x1, y1, **more):
    return {"n": n, "members": [n], "x0": x0, "y0": y0, "x1": x1, "y1": y1, "kind": "text", "role": None, "edge_role": None, "confidence": None} | more


def test_nested_regions_grow_their_host():
    kept = P.host_regions([region(1, 0, 0, 100, 100), region(2, 90, 10, 120, 20), region(3, 10, 10, 50, 50, confidence=0.5), region(4, 10, 10, 50, 50, kind="list")])
    assert [k["members"] for k in kept] == [[1, 3], [2], [4]]
    assert kept[0]["confidence"] == 0.5


def title(n, y0, **more):
    return region(n, 0.0, y0, 200.0, y0 + 12, kind="title", text=f"t{n}", sizes=[10.0], fonts=["A"], weights=[400.0]) | more


def test_titles_join_while_style_holds():
    kept = P.join_titles([title(1, 0), title(2, 16), title(3, 32, sizes=[14.0]), title(4, 48, sizes=[14.0], fonts=["B"]), title(5, 200, sizes=[14.0], fonts=["B"])])
    assert [k["members"] for k in kept] == [[1, 2], [3], [4], [5]]
    assert kept[0]["text"] == "t1\nt2"


def test_merges_run_by_page(spark):
    rows = [(1, 1, 0.0, 0.0, 200.0, 12.0, "title", "a", [10.0], ["A"], None), (1, 2, 0.0, 16.0, 200.0, 28.0, "title", "b", None, [None], [400.0]), (2, 1, 0.0, 16.0, 200.0, 28.0, "title", None, None, None, None)]
    df = spark.createDataFrame(rows, "pg int, n int, x0 double, y0 double, x1 double, y1 double, kind string, text string, sizes array<double>, fonts array<string>, weights array<double>")
    got = {(r.pg, tuple(r.members), r.text) for r in P.merge_titles(df, ["pg"], "n").collect()}
    assert got == {(1, (1, 2), "a\nb"), (2, (1,), None)}
    assert P.merge_titles(df.where("false"), ["pg"], "n").count() == 0


def test_validity_names_every_fault_once(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, 1, 1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 1, 0, 1, 1, 1, 20.0, 0.0, 30.0, 10.0, "b"), (2, 0, 0, 0, 1, 2, 0.0, 0.0, 10.0, 10.0, ""), (2, 1, 0, 1, 1, 1, 5.0, 0.0, 5.0, 10.0, None), (2, 2, 5, 0, 1, 1, None, None, None, None, "z"), (2, 3, 0, 0, 0, 1, 0.0, 0.0, 1.0, 1.0, "z")],
        "pg int, cell_no int, row int, col int, rowspan int, colspan int, x0 double, y0 double, x1 double, y1 double, text string")
    tables = spark.createDataFrame([(1, 1, 2, False), (2, 1, 2, False), (3, 0, 0, False)], "pg int, row_count int, column_count int, rtl boolean")
    tables = tables.select("*", *[F.lit(None).cast("double").alias(f"f_{c}") for c in X.BOX])
    tokens = spark.createDataFrame([(1, 0, 0, 5.0, 2.0, 3.0, 8.0, 7.0), (1, 1, 0, 5.0, 22.0, 3.0, 28.0, 7.0), (2, 0, 0, 95.0, 92.0, 93.0, 98.0, 97.0)], "pg int, token_no int, line_no int, line_cy double, x0 double, y0 double, x1 double, y1 double")
    got = {r.pg: r for r in X.validity(tables, cells, tokens, ["pg"]).collect()}
    assert got[1].valid and got[1].reasons == [] and got[1].coverage == 1.0
    assert got[2].reasons == ["overlapping_cell_spans", "missing_table_row", "cell_bbox_non_positive", "cell_index_out_of_range", "unexpected_cell_overlap", "source_assignment_conflicts", "low_token_coverage"]
    assert got[2].conflicts == 1
    assert got[3].reasons == ["invalid_table_dimensions", "no_cells"]


def test_upright_and_gap_are_inverse(spark):
    page = G.lit_box(10, 20, 310, 420)
    for turn in (0, 90, 180, 270):
        for own in (0, 90, 180, 270):
            a = R.upright(G.lit_box(50, 60, 90, 70), F.lit(own), F.lit(turn), page)
            back = R.gap(G.Box(a.x0, a.y0, a.x0, a.y1), G.Box(a.x1, a.y0, a.x1, a.y1), F.lit(own), F.lit(turn), page)
            row = spark.range(1).select(*[c.alias(n) for n, c in zip("abcd", back, strict=True)]).first()
            assert tuple(row) == (50.0, 60.0, 90.0, 70.0), (turn, own)


def test_spaces(spark):
    cases = [("R$", "12", 5, False), ("a", ",", 5, False), ("(", "x", 5, False), ("ab", "cd", 5, True), ("ab", "cd", -2, True), ("abc", "def", -2, False), (None, "x", 5, True), (None, "x", -2, False)]
    df = spark.createDataFrame([(a, b, float(g)) for a, b, g, _ in cases], "a string, b string, g double")
    zero, ten = F.lit(0.0), F.lit(10.0)
    got = df.select(R.needs_space(F.col("a"), F.col("b"), G.Box(zero, zero, ten, ten), G.Box(ten + F.col("g"), zero, ten + 20, ten)).alias("s")).collect()
    assert [r.s for r in got] == [c[3] for c in cases]


def test_settings(monkeypatch):
    monkeypatch.setenv("FOLIANT_X", "4")
    assert settings.bounded_int("FOLIANT_X", 1, 0, 9) == 4 and settings.bounded_float("FOLIANT_Y", 1.5) == 1.5
    for bad, kw in (("z", {}), ("4", {"most": 3}), ("4", {"least": 5}), ("4", {"allowed": {1}})):
        monkeypatch.setenv("FOLIANT_X", bad)
        with pytest.raises(settings.SettingError):
            settings.bounded_int("FOLIANT_X", 1, **kw)
    monkeypatch.setenv("FOLIANT_X", "inf")
    with pytest.raises(settings.SettingError):
        settings.bounded_float("FOLIANT_X", 1.0)
