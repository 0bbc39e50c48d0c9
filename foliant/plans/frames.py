"""Frames, spaces, marks, titles and fragments over the synthetic pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames as R
from ..functions import geometry as G
from ..functions import text as T
from ..operators import fragments as P
from .base import BOXES, boxes, table
from .registry import query

SIDES = ("x0", "y0", "x1", "y1")
TURN = "(pg % 4) * 90"


def sides(b: G.Box, prefix: str = "") -> list:
    return [F.round(c, 6).alias(prefix + n) for n, c in zip(SIDES, b, strict=True)]


#: a quarter turn of a crop twice as large as its region of 200 by 100 points, back to the crop
BACK = (0.0, 1.0, 0.0, -1.0, 0.0, 400.0)


@query(
    "g16_variant_to_region",
    f"""WITH {BOXES}, m AS (SELECT pg, bid, y0 AS ax, y1 AS bx, 400 - x1 AS ay, 400 - x0 AS bty FROM b), c AS (SELECT pg, bid, least(greatest(ax, 0), 400) AS ax, least(greatest(bx, 0), 400) AS bx, least(greatest(ay, 0), 200) AS ay, least(greatest(bty, 0), 200) AS bty FROM m)
    SELECT pg, bid, round(50 + ax * 0.5, 6) AS x0, round(60 + ay * 0.5, 6) AS y0, round(50 + bx * 0.5, 6) AS x1, round(60 + bty * 0.5, 6) AS y1 FROM c""",
)
def variant_to_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = G.lit_box(50, 60, 250, 160)
    return boxes(spark, sf_dir).select("pg", "bid", *sides(R.variant_to_region(G.box(), BACK, F.lit(400.0), F.lit(200.0), region)))


@query(
    "g17_g23_unturned_boxes",
    f"""WITH {BOXES} SELECT pg, bid, CASE {TURN} WHEN 90 THEN y0 WHEN 180 THEN 900 - x1 WHEN 270 THEN 900 - y1 ELSE x0 END AS x0, CASE {TURN} WHEN 90 THEN 800 - x1 WHEN 180 THEN 800 - y1 WHEN 270 THEN x0 ELSE y0 END AS y0,
      CASE {TURN} WHEN 90 THEN y1 WHEN 180 THEN 900 - x0 WHEN 270 THEN 900 - y0 ELSE x1 END AS x1, CASE {TURN} WHEN 90 THEN 800 - x0 WHEN 180 THEN 800 - y0 WHEN 270 THEN x1 ELSE y1 END AS y1,
      least(greatest(CAST(floor(x0) AS INT), 0), 450) AS crop_x0, least(greatest(CAST(floor(y1) AS INT), 0), 600) AS crop_y1 FROM b""",
)
def unturned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a turned raster in its source, and the whole pixels of a crop."""
    crop = R.crop_bounds(G.box(), F.lit(450), F.lit(600))
    back = G.unrotate(G.box(), F.col("pg") % 4 * 90, F.lit(900.0), F.lit(800.0))
    return boxes(spark, sf_dir).select("pg", "bid", *[c.alias(n) for n, c in zip(SIDES, back, strict=True)], crop.x0.alias("crop_x0"), crop.y1.alias("crop_y1"))


UPRIGHT = f"""s AS (SELECT pg, bid, kind, status, conf, {TURN} AS pr, (bid % 4) * 90 AS tr, x0 - 10 AS x0, y0 - 20 AS y0, x1 - 10 AS x1, y1 - 20 AS y1 FROM b),
 v AS (SELECT pg, bid, kind, tr, pr, CASE WHEN pr IN (90, 270) THEN 800 ELSE 600 END AS w, CASE WHEN pr IN (90, 270) THEN 600 ELSE 800 END AS h, CASE pr WHEN 90 THEN 800 - y1 WHEN 180 THEN 600 - x1 WHEN 270 THEN y0 ELSE x0 END AS x0, CASE pr WHEN 90 THEN x0 WHEN 180 THEN 800 - y1 WHEN 270 THEN 600 - x1 ELSE y0 END AS y0,
  CASE pr WHEN 90 THEN 800 - y0 WHEN 180 THEN 600 - x0 WHEN 270 THEN y1 ELSE x1 END AS x1, CASE pr WHEN 90 THEN x1 WHEN 180 THEN 800 - y0 WHEN 270 THEN 600 - x0 ELSE y1 END AS y1 FROM s),
 u AS (SELECT pg, bid, kind, CASE tr WHEN 90 THEN y0 WHEN 180 THEN w - x1 WHEN 270 THEN w - y1 ELSE x0 END AS x0, CASE tr WHEN 90 THEN h - x1 WHEN 180 THEN h - y1 WHEN 270 THEN x0 ELSE y0 END AS y0,
  CASE tr WHEN 90 THEN y1 WHEN 180 THEN w - x0 WHEN 270 THEN w - y0 ELSE x1 END AS x1, CASE tr WHEN 90 THEN h - x0 WHEN 180 THEN h - y0 WHEN 270 THEN x1 ELSE y1 END AS y1 FROM v)"""
SHEET = (10, 20, 610, 820)


def upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = R.upright(G.box(), F.col("bid") % 4 * 90, F.col("pg") % 4 * 90, G.lit_box(*SHEET))
    return boxes(spark, sf_dir).select("pg", "bid", "kind", *[c.alias(n) for n, c in zip(SIDES, up, strict=True)])


@query("g22_upright_boxes", f"WITH {BOXES}, {UPRIGHT} SELECT pg, bid, x0, y0, x1, y1 FROM u")
def upright_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upright(spark, sf_dir).drop("kind")


@query(
    "g22_gap_boxes",
    f"""WITH {BOXES}, g AS (SELECT pg, bid, x0, y0, y1, lag(x1) OVER o AS px1, lag(y0) OVER o AS py0, lag(y1) OVER o AS py1 FROM b WHERE pg % 4 < 2 WINDOW o AS (PARTITION BY pg ORDER BY bid)),
    m AS (SELECT pg, bid, CASE WHEN x0 < px1 THEN (px1 + x0) / 2 ELSE px1 END AS l, CASE WHEN x0 < px1 THEN (px1 + x0) / 2 ELSE x0 END AS r, least(y0, py0) AS t, greatest(y1, py1) AS d FROM g WHERE px1 IS NOT NULL)
    SELECT pg, bid, round(10 + CASE WHEN pg % 4 = 1 THEN t ELSE l END, 6) AS x0, round(20 + CASE WHEN pg % 4 = 1 THEN 800 - r ELSE t END, 6) AS y0, round(10 + CASE WHEN pg % 4 = 1 THEN d ELSE r END, 6) AS x1, round(20 + CASE WHEN pg % 4 = 1 THEN 800 - l ELSE d END, 6) AS y1 FROM m""",
)
def gap_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page boxes of the spaces between neighbours, for upright tokens of two turns of pages."""
    w = W.partitionBy("pg").orderBy("bid")
    b = boxes(spark, sf_dir).where("pg % 4 < 2").withColumns({f"p_{c}": F.lag(c).over(w) for c in SIDES}).where("p_x1 IS NOT NULL")
    g = R.gap(G.box("p_"), G.box(), F.lit(0), F.col("pg") % 4 * 90, G.lit_box(*SHEET))
    return b.select("pg", "bid", *sides(g))


SAID = """CASE bid % 9 WHEN 0 THEN 'R$' WHEN 1 THEN '12' WHEN 2 THEN ',' WHEN 3 THEN '(' WHEN 4 THEN 'word' WHEN 5 THEN 'a' WHEN 6 THEN 'two words' WHEN 7 THEN '' ELSE 'end)' END"""


def said(n: Column) -> Column:
    out = F.when(n % 9 == 0, "R$")
    for i, t in enumerate(("12", ",", "(", "word", "a", "two words", ""), start=1):
        out = out.when(n % 9 == i, t)
    return out.otherwise("end)")


@query(
    "f16_spaces",
    f"""WITH {BOXES}, a AS (SELECT pg, bid, {SAID.replace("bid", "(bid + pg)")} AS t, x0, y0, x1, y1 FROM b),
    g AS (SELECT pg, bid, t, x0, y1 - y0 AS h, lag(t) OVER o AS pt, lag(x1) OVER o AS px1, lag(y1 - y0) OVER o AS ph FROM a WINDOW o AS (PARTITION BY pg ORDER BY x0, bid)),
    c AS (SELECT *, pt LIKE '% %' OR t LIKE '% %' AS sp FROM g WHERE pt IS NOT NULL)
    SELECT pg, bid, CASE WHEN x0 >= px1 THEN t = '' OR pt = '' OR NOT (regexp_matches(t, '^[,.:;!?%)\\]}}]') OR regexp_matches(pt, '[(\\[{{]$') OR (upper(pt) = 'R$' AND regexp_matches(t, '^[0-9]')))
      ELSE t <> '' AND pt <> '' AND regexp_matches(pt, '[A-Za-z0-9]$') AND regexp_matches(t, '^[A-Za-z0-9]') AND px1 - x0 <= greatest(h, ph, 1) * CASE WHEN sp THEN 0.75 ELSE 0.45 END AND (sp OR length(pt) <= 2 OR length(t) <= 2) END AS space FROM c""",
)
def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("pg").orderBy("x0", "bid")
    a = boxes(spark, sf_dir).withColumn("t", said(F.col("bid") + F.col("pg")))
    a = a.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("t", *SIDES)}).where("p_t IS NOT NULL")
    return a.select("pg", "bid", R.needs_space(F.col("p_t"), F.col("t"), G.box("p_"), G.box()).alias("space"))


@query(
    "p04_marks",
    f"""WITH {BOXES}, a AS (SELECT pg, bid, CASE bid % 5 WHEN 0 THEN ',' WHEN 1 THEN ' ' WHEN 2 THEN chr(10) WHEN 3 THEN 'x' ELSE '' END AS t, x1 - x0 AS w, y1 - y0 AS h, pg % 4 AS mode FROM b)
    SELECT pg, bid, t NOT IN ('', chr(10)) AND mode <> 3 AS visible, t IN (',', ' ', chr(10)) AS mark, t = ',' AND w <= greatest(10, h * 1.8) AS ghost FROM a""",
)
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bid") % 5
    t = F.when(n == 0, ",").when(n == 1, " ").when(n == 2, "\n").when(n == 3, "x").otherwise("")
    return boxes(spark, sf_dir).select("pg", "bid", R.visible_glyph(t, G.box(), F.col("pg") % 4).alias("visible"), R.inline_mark(t).alias("mark"), R.ghost_punctuation(t, G.box()).alias("ghost"))


@query(
    "p26_page_titles",
    f"""WITH {BOXES}, a AS (SELECT pg, bid, {SAID} AS t, kind = 'R' AND bid % 2 = 0 AS title, CASE {TURN} WHEN 90 THEN x0 <= 0.22 * 550 WHEN 180 THEN y1 >= 750 - 0.22 * 750 WHEN 270 THEN x1 >= 550 - 0.22 * 550 ELSE y0 <= 0.22 * 750 END AS top FROM b),
    f AS (SELECT pg, t, min(bid) AS n FROM a WHERE t <> '' AND (title OR top) GROUP BY ALL) SELECT pg, string_agg(t, '|' ORDER BY n) AS titles FROM f GROUP BY pg""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct title-like texts of a page in order."""
    n = F.col("bid")
    ok = R.title_like(F.col("t"), (F.col("kind") == "R") & (n % 2 == 0), G.box(), G.lit_box(0, 0, 550, 750), F.col("pg") % 4 * 90)
    found = boxes(spark, sf_dir).withColumn("t", said(n)).where(ok).groupBy("pg", F.trim("t").alias("t")).agg(F.min("bid").alias("n"))
    return found.groupBy("pg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda s: s.t), "|").alias("titles"))


@query(
    "f34_half_turns",
    """WITH a AS (SELECT l_orderkey AS pg, CASE l_suppkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '180_degree' WHEN 3 THEN 'up' ELSE '7' END AS v, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount * 10 END AS c FROM lineitem),
    r AS (SELECT pg, CASE WHEN v IN ('1', '180_degree') THEN 180 ELSE 0 END AS r, c IS NULL OR c >= 0.5 AS ok FROM a)
    SELECT pg, CASE WHEN count(*) FILTER (WHERE ok AND r = 180) >= 0.6 * greatest(count(*) FILTER (WHERE ok), 1) THEN 180 ELSE 0 END AS rotation FROM r GROUP BY pg""",
)
def half_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 5
    v = F.when(s == 0, "1").when(s == 1, "0").when(s == 2, "180_degree").when(s == 3, "up").otherwise("7")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pg"), R.turned_flag(v).alias("r"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount") * 10).alias("c"))
    return li.groupBy("pg").agg(R.half_turn(F.col("r"), F.lit("x"), F.col("c")).alias("rotation"))


@query(
    "f33_paragraph_text",
    """WITH r AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t, coalesce(lag(turn % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn, text), FALSE) AS tight FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS n FROM r WHERE t <> '')
    SELECT conv_id, string_agg(CASE WHEN n > 1 AND NOT tight THEN ' ' ELSE '' END || t, '' ORDER BY n) AS text FROM k GROUP BY conv_id""",
)
def paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines as one paragraph: a space between, unless the line before says it joins on."""
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    t = F.trim(F.coalesce("text", F.lit("")))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), F.coalesce(F.lag(F.col("turn") % 3 == 0).over(w), F.lit(False)).alias("tight"))
    k = r.where("t <> ''").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "t")))
    part = F.concat(F.when((F.col("n") > 1) & ~F.col("tight"), " ").otherwise(""), F.col("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda s: s.p), "")
    return k.groupBy("conv_id").agg(whole.alias("text")).select("conv_id", F.trim(T.normalize_reading_text(F.col("text"))).alias("text"))


CATEGORIES = ("matched_exact", "fragmented_but_complete", "spacing_changed", "unicode_substitution", "missing", "not_assessable", "unmatched_native")


@query(
    "a34_alignment_rates",
    f"""WITH a AS (SELECT l_orderkey // 40 AS page, l_linestatus AS stage, [{", ".join(f"'{c}'" for c in CATEGORIES)}][l_partkey % 7 + 1] AS c FROM lineitem), u AS (SELECT *, c <> 'unmatched_native' AS unit FROM a)
    SELECT page, stage, count(*) AS records, count(*) FILTER (WHERE unit) AS units, count(*) FILTER (WHERE NOT unit) AS unmatched_native, count(*) FILTER (WHERE unit AND c <> 'not_assessable') AS assessable,
      count(*) FILTER (WHERE c IN ('matched_exact', 'fragmented_but_complete')) AS strict, count(*) FILTER (WHERE c IN ('matched_exact', 'fragmented_but_complete', 'spacing_changed', 'unicode_substitution')) AS permissive
    FROM u GROUP BY CUBE (page, stage)""",
)
def alignment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records by page and stage, each alone and over all: numerators and denominator of the rates."""
    c = F.array(*[F.lit(x) for x in CATEGORIES])[(F.col("l_partkey") % 7).cast("int")]
    a = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 40").alias("page"), F.col("l_linestatus").alias("stage"), c.alias("c"))
    unit, some = F.col("c") != "unmatched_native", F.count_if
    return a.cube("page", "stage").agg(
        F.count(F.lit(1)).alias("records"), some(unit).alias("units"), some(~unit).alias("unmatched_native"), some(unit & (F.col("c") != "not_assessable")).alias("assessable"),
        some(F.col("c").isin(*CATEGORIES[:2])).alias("strict"), some(F.col("c").isin(*CATEGORIES[:4])).alias("permissive"))


@query("j18_coalesced_regions")
def coalesced_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    r = b.select("pg", "bid", F.col("x0"), "y0", (F.col("x0") + F.col("bid") * 60).alias("x1"), (F.col("y0") + F.col("bid") * 60).alias("y1"), "kind", F.lit(None).cast("string").alias("role"), F.lit("none").alias("edge_role"), F.col("conf").cast("double").alias("confidence"))
    return P.coalesce_nested(r, ["pg"], "bid").withColumn("members", F.array_join("members", ","))


@query("j24_merged_titles")
def merged_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bid")
    r = boxes(spark, sf_dir).select(
        "pg", "bid", (F.col("x0") % 20).alias("x0"), (n * 20.0).alias("y0"), (F.col("x0") % 20 + 200).alias("x1"), (n * 20.0 + 12).alias("y1"),
        F.when(F.col("kind") == "A", "text").otherwise("title").alias("kind"), F.concat(F.lit("t"), n.cast("string")).alias("text"),
        F.array((10 + n % 4).cast("double")).alias("sizes"), F.array(F.col("status")).alias("fonts"), F.array(F.lit(400.0)).alias("weights"))
    return P.merge_titles(r, ["pg"], "bid").withColumn("members", F.array_join("members", ","))


@query("f27_cell_text")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    t = F.when(F.col("pg") % 2 == 0, F.substring("kind", 1, 1)).otherwise(said(F.col("bid")))
    return P.joined(b.select("pg", F.col("bid").alias("token_no"), t.alias("text"), (F.col("bid") * 12.0 + F.col("x0") % 5).alias("x0"), (F.col("y0") % 3 * 12).alias("y0"), (F.col("bid") * 12.0 + 9).alias("x1"), (F.col("y0") % 3 * 12 + 10).alias("y1")), ["pg"])


@query(
    "d30_split_spaces",
    """WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)),
    k AS (SELECT doc_id, n, trim(w) AS w, lead(trim(w)) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM t WHERE trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
    SELECT doc_id, count(*) FILTER (WHERE NOT coalesce(length(w) >= 4 AND length(nx) <= 3 AND regexp_matches(w, '[\\p{L}\\p{N}]$') AND regexp_matches(nx, '^[\\p{L}\\p{N}]'), FALSE)) AS spaces FROM k WHERE nx IS NOT NULL GROUP BY doc_id""",
)
def split_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces that stay between the words of every document."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "w"))
    d = d.where(F.trim(F.regexp_replace("w", r"[\x09-\x0D]", " ")) != "")
    both = d.select("doc_id", F.explode(F.array(F.struct((2 * F.col("n")).alias("token_no"), F.col("w").alias("text")), F.struct((2 * F.col("n") + 1).alias("token_no"), F.lit(" ").alias("text")))).alias("t")).select("doc_id", "t.*")
    last = F.max("token_no").over(W.partitionBy("doc_id"))
    kept = P.drop_split_spaces(both.withColumn("_l", last).where("token_no < _l").drop("_l"), ["doc_id"])
    n = kept.groupBy("doc_id").agg(F.count_if(F.col("text") == " ").alias("spaces"), F.count_if(F.col("text") != " ").alias("words"))
    return n.where("words > 1").drop("words")


@query(
    "p03_covered_cells",
    f"""WITH {BOXES}, k AS (SELECT pg, bid, bid // 3 AS cell, CASE kind WHEN 'A' THEN 'aa' WHEN 'N' THEN 'nn' ELSE 'rr' END AS t, bid * 40 + x0 % 9 AS x0, y0 % 9 AS y0, bid * 40 + x0 % 9 + 20 AS x1, y0 % 9 + 10 AS y1 FROM b),
    v AS (SELECT DISTINCT l.pg, l.bid FROM k l JOIN k r ON l.pg = r.pg AND r.bid % 2 = 0 AND l.bid = r.bid AND r.pg % 3 = 0)
    SELECT pg, cell, coalesce(string_agg(t, ' ' ORDER BY k.bid) FILTER (WHERE v.bid IS NULL), '') AS text FROM k LEFT JOIN v USING (pg, bid) GROUP BY pg, cell""",
)
def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of cells after covers hid every other token of a third of the pages."""
    n = F.col("bid")
    text = F.when(F.col("kind") == "A", "aa").when(F.col("kind") == "N", "nn").otherwise("rr")
    x0, y0 = n * 40 + F.col("x0") % 9, F.col("y0") % 9
    k = boxes(spark, sf_dir).select("pg", F.expr("bid div 3").alias("cell"), n.alias("token_no"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 10).alias("y1"))
    covers = k.where("pg % 3 = 0 AND token_no % 2 = 0").select("pg", "x0", "y0", (F.col("x1") - 12).alias("x1"), "y1")
    return P.clear_covered(k, covers, ["pg"], ["cell"])


@query("p23_blank_rasters", "SELECT l_orderkey AS pg, min(240 + l_quantity % 16) >= 250 AND max(240 + l_quantity % 16) - min(240 + l_quantity % 16) <= 3 AS blank FROM lineitem GROUP BY l_orderkey")
def blank_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = 240 + F.col("l_quantity") % 16
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pg")).agg(R.blank_raster(F.min(grey), F.max(grey)).alias("blank"))
