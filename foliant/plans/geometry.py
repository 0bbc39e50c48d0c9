"""Geometry: box measures, transforms, spatial joins, assignments, areas, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as S
from .base import AREA, BOXES, SHARED, boxes
from .registry import query

PAGE = (0, 0, 400, 60)
MEASURES = """
  SELECT pg, bid, x1 - x0 AS width, y1 - y0 AS height, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area,
         (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 + 3) - (x0 - 3) AS wider
  FROM b"""


@query("g01_g02_box_measures", f"WITH {BOXES} {MEASURES}")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box()
    cx, cy = G.center(b)
    return boxes(spark, sf_dir).select(
        "pg", "bid", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"),
        cx.alias("cx"), cy.alias("cy"), G.width(G.expand(b, 3)).alias("wider"),
    )


@query(
    "g03_g05_box_pairs",
    f"""WITH {BOXES}, j AS (
      SELECT l.pg, l.bid AS a, r.bid AS b, {SHARED} AS common, {AREA.format('l')} AS la, {AREA.format('r')} AS ra,
             least(l.x1, r.x1) - greatest(l.x0, r.x0) AS w
      FROM b l JOIN b r ON l.pg = r.pg AND l.bid < r.bid
        AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)
    SELECT pg, a, b, w, common, common / la AS overlap, common / (la + ra - common) AS iou FROM j""",
)
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that meet, over a page-and-cell equi-join."""
    b = boxes(spark, sf_dir)
    left, right = G.box("l_"), G.box("r_")
    pairs = S.spatial_join(S.prefixed(b, "l_"), S.prefixed(b, "r_"), ["pg"], F.col("l_bid") < F.col("r_bid"))
    return pairs.select(
        F.col("l_pg").alias("pg"), F.col("l_bid").alias("a"), F.col("r_bid").alias("b"),
        G.width(G.intersection(left, right)).alias("w"), G.shared_area(left, right).alias("common"),
        G.overlap_ratio(left, right).alias("overlap"), G.iou(left, right).alias("iou"),
    )


@query(
    "g06_group_box",
    f"WITH {BOXES} SELECT pg, kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY pg, kind",
)
def group_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("pg", "kind").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")
    )


@query(
    "g07_flip_coordinates",
    f"WITH {BOXES} SELECT pg, bid, x0 - 5 AS x0, 807 - y1 AS y0, x1 - 5 AS x1, 807 - y0 AS y1, 800 - (807 - y0) AS bottom FROM b",
)
def flip_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box()
    h = F.lit(800.0)
    # every other box comes with its edges swapped
    turned = F.col("bid") % 2 == 0
    swap = lambda a, c: (F.when(turned, c).otherwise(a), F.when(turned, a).otherwise(c))
    (x0, x1), (y0, y1) = swap(b.x0, b.x1), swap(b.y0, b.y1)
    t = G.flip_y(x0, y0, x1, y1, h, F.lit(5.0), F.lit(7.0))
    return boxes(spark, sf_dir).select("pg", "bid", *[c.alias(n) for c, n in zip(t, ("x0", "y0", "x1", "y1"), strict=True)], G.unflip_y(t, h)[1].alias("bottom"))


@query(
    "g08_rotate",
    f"""WITH {BOXES}, r AS (SELECT *, (bid % 5) * 90 AS rot FROM b)
    SELECT pg, bid, rot,
      CASE rot % 360 WHEN 90 THEN 900 - y1 WHEN 180 THEN 700 - x1 WHEN 270 THEN y0 ELSE x0 END AS x0,
      CASE rot % 360 WHEN 90 THEN x0 WHEN 180 THEN 900 - y1 WHEN 270 THEN 700 - x1 ELSE y0 END AS y0,
      CASE rot % 360 WHEN 90 THEN 900 - y0 WHEN 180 THEN 700 - x0 WHEN 270 THEN y1 ELSE x1 END AS x1,
      CASE rot % 360 WHEN 90 THEN x1 WHEN 180 THEN 900 - y0 WHEN 270 THEN 700 - x0 ELSE y1 END AS y1,
      TRUE AS returns FROM r""",
)
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation into the reading frame; ``returns`` checks the inverse."""
    w, h = F.lit(700.0), F.lit(900.0)
    b = boxes(spark, sf_dir).withColumn("rot", (F.col("bid") % 5) * 90)
    t = G.rotate(G.box(), F.col("rot"), w, h)
    back = G.unrotate(t, F.col("rot"), w, h)
    same = F.lit(True)
    for a, c in zip(back, G.box(), strict=True):
        same = same & (F.abs(a - c) < 1e-9)
    return b.select("pg", "bid", "rot", *[c.alias(n) for c, n in zip(t, ("x0", "y0", "x1", "y1"), strict=True)], same.alias("returns"))


@query(
    "g09_g20_clamp_to_page",
    f"""WITH {BOXES}, s AS (SELECT pg, bid, least(greatest(x0 * 0.5, 0), 200) AS x0, least(greatest(y0 * 0.5, 0), 40) AS y0,
        least(greatest(x1 * 0.5, 0), 200) AS x1, least(greatest(y1 * 0.5, 0), 40) AS y1 FROM b)
    SELECT * FROM s WHERE x1 > x0 AND y1 > y0""",
)
def clamp_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = G.lit_box(0, 0, 200, 40)
    t = G.raster_to_page(G.box(), F.lit(400.0), F.lit(80.0), page)
    out = boxes(spark, sf_dir).select("pg", "bid", *[c.alias(n) for c, n in zip(t, ("x0", "y0", "x1", "y1"), strict=True)])
    return out.where("x1 > x0 AND y1 > y0")


@query(
    "g10_polygons",
    f"""WITH {BOXES} SELECT pg, bid, x0, y0, x1, y1 FROM b WHERE bid % 3 <> 0""",
)
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals to boxes; those with a missing or infinite point fall out."""
    b = boxes(spark, sf_dir)
    bad = F.when(F.col("bid") % 6 == 0, F.lit(float("inf"))).when(F.col("bid") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("x0"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(bad, F.col("y0")), point(F.col("x1"), F.col("y0")), point(F.col("x1"), F.col("y1")), point(F.col("x0"), F.col("y1")))
    return b.select("pg", "bid", G.polygon_box(quad).alias("q")).where("q IS NOT NULL").select("pg", "bid", "q.*")


SLABS = """solid AS (SELECT {k}, x0, y0, x1, y1 FROM {t} WHERE x1 > x0 AND y1 > y0),
 e AS (SELECT DISTINCT {k}, unnest([x0, x1]) AS sx FROM solid),
 s AS (SELECT *, lead(sx) OVER (PARTITION BY {k} ORDER BY sx) AS ex FROM e),
 i AS (SELECT {ks}, s.sx, s.ex, o.y0, o.y1 FROM s JOIN solid o USING ({k}) WHERE s.ex IS NOT NULL AND o.x0 < s.ex AND o.x1 > s.sx),
 m AS (SELECT *, max(y1) OVER (PARTITION BY {k}, sx ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
 a AS (SELECT {k}, sum((ex - sx) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS union_area FROM m GROUP BY {k})"""


@query(
    "g11_union_area",
    f"WITH {BOXES}, {SLABS.format(k='pg', ks='s.pg', t='b')} SELECT pg, union_area, least(1.0, union_area / 500000) AS coverage FROM a",
)
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area of the boxes' union per page, without pairs of boxes."""
    u = S.union_area(boxes(spark, sf_dir), ["pg"])
    return u.withColumn("coverage", F.least(F.lit(1.0), F.col("union_area") / 500000))


@query(
    "g12_image_coverage",
    f"""WITH {BOXES}, c AS (SELECT pg, greatest(x0, 100) AS x0, greatest(y0, 20) AS y0, least(x1, 300) AS x1, least(y1, 80) AS y1 FROM b),
    {SLABS.format(k='pg', ks='s.pg', t='c')}
    SELECT b.pg, coalesce(any_value(a.union_area), 0) / 12000 AS covered FROM b LEFT JOIN a USING (pg) GROUP BY b.pg""",
)
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an image's box that a page's boxes cover, after clipping to it."""
    image = G.lit_box(100, 20, 300, 80)
    b = boxes(spark, sf_dir)
    clipped = G.shared(G.box(), image)
    cut = b.select("pg", *[c.alias(n) for c, n in zip(clipped, ("x0", "y0", "x1", "y1"), strict=True)])
    return (
        b.select("pg").distinct().join(S.union_area(cut, ["pg"]), "pg", "left")
        .select("pg", (F.coalesce("union_area", F.lit(0.0)) / 12000).alias("covered"))
    )


@query(
    "g13_g14_scale_plan",
    f"""WITH {BOXES}, d AS (SELECT pg, bid, CAST(x1 * 10 AS BIGINT) AS w, CAST(y1 * 10 AS BIGINT) AS h FROM b),
    p AS (SELECT d.*, s.scale,
        CASE WHEN s.scale > 1 THEN greatest(w + 1, CAST(round_even(w * s.scale, 0) AS BIGINT)) ELSE greatest(1, CAST(round_even(w * s.scale, 0) AS BIGINT)) END AS sw,
        CASE WHEN s.scale > 1 THEN greatest(h + 1, CAST(round_even(h * s.scale, 0) AS BIGINT)) ELSE greatest(1, CAST(round_even(h * s.scale, 0) AS BIGINT)) END AS sh
      FROM d, (VALUES (1.0), (1.5), (2.0), (3.0)) AS s(scale) WHERE w > 0)
    SELECT pg, bid, CAST(scale AS DOUBLE) AS scale, sw, sh, sw * sh * 3 <= 4000000 AS allowed,
        round(least(3.0, sqrt(least(1000000.0, 4000000.0 / 3) / (w * h))), 9) AS safe_scale FROM p""",
)
def scale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster scales a byte budget allows, and the greatest safe one."""
    d = boxes(spark, sf_dir).select("pg", "bid", (F.col("x1") * 10).cast("long").alias("w"), (F.col("y1") * 10).cast("long").alias("h")).where("w > 0")
    d = d.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in (1.0, 1.5, 2.0, 3.0)])))
    sw, sh = G.scaled_dim(F.col("w"), F.col("scale")), G.scaled_dim(F.col("h"), F.col("scale"))
    return d.select("pg", "bid", "scale", sw.alias("sw"), sh.alias("sh"), (sw * sh * 3 <= 4000000).alias("allowed"),
                    F.round(G.safe_scale(F.col("w"), F.col("h"), 3.0, 1e6, 4e6), 9).alias("safe_scale"))


@query(
    "g15_tiles",
    f"""WITH {BOXES}, d AS (SELECT pg, CAST(max(x1) AS BIGINT) AS w, CAST(max(y1) AS BIGINT) AS h FROM b GROUP BY pg),
    n AS (SELECT d.*, min(g) AS n FROM d, (SELECT unnest(range(1, 9)) AS g) WHERE ceil(w / g) * ceil(h / g) * 3 <= 9000 OR g = 8 GROUP BY ALL)
    SELECT pg, n, r, c, greatest(0, c * (w // n) - 4) AS x0, greatest(0, r * (h // n) - 4) AS y0,
        CASE WHEN c = n - 1 THEN w ELSE least(w, (c + 1) * (w // n) + 4) END AS x1,
        CASE WHEN r = n - 1 THEN h ELSE least(h, (r + 1) * (h // n) + 4) END AS y1
    FROM n, LATERAL (SELECT unnest(range(0, n)) AS r), LATERAL (SELECT unnest(range(0, n)) AS c)""",
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles of the least grid whose tiles fit a byte budget."""
    d = boxes(spark, sf_dir).groupBy("pg").agg(F.max("x1").cast("long").alias("w"), F.max("y1").cast("long").alias("h"))
    fits = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long")), lambda g: (F.ceil(F.col("w") / g) * F.ceil(F.col("h") / g) * 3 <= 9000) | (g == 8))
    d = d.withColumn("n", F.array_min(fits))
    cells = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    d = d.withColumn("r", cells()).withColumn("c", cells()).withColumns({"tw": F.expr("w div n"), "th": F.expr("h div n")})
    edge = lambda k, t, m: F.when(F.col(k) == F.col("n") - 1, F.col(m)).otherwise(F.least(F.col(m), (F.col(k) + 1) * F.col(t) + 4))
    zero = F.lit(0).cast("long")
    return d.select("pg", "n", "r", "c", F.greatest(zero, F.col("c") * F.col("tw") - 4).alias("x0"), F.greatest(zero, F.col("r") * F.col("th") - 4).alias("y0"),
                    edge("c", "tw", "w").alias("x1"), edge("r", "th", "h").alias("y1"))


@query(
    "g19_merge_intervals",
    f"""WITH {BOXES}, m AS (SELECT pg, x0, x1, max(x1) OVER (PARTITION BY pg ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pg ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS isl FROM m)
    SELECT pg, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY pg, isl""",
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_intervals(boxes(spark, sf_dir).select("pg", "x0", "x1"), ["pg"], "x0", "x1")


@query(
    "d05_column_gaps",
    f"""WITH {BOXES}, g AS (SELECT pg, bid, x0, x1, lag(x1) OVER (PARTITION BY pg ORDER BY x0, bid) AS before FROM b),
    s AS (SELECT *, greatest(8, 3.5 * median(x1 - x0) OVER (PARTITION BY pg)) AS limit_ FROM g)
    SELECT pg, bid, CAST(sum(CASE WHEN before IS NULL OR x0 - before > limit_ THEN 1 ELSE 0 END) OVER (PARTITION BY pg ORDER BY x0, bid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM s""",
)
def column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split a row of boxes where the gap is wide against the median width."""
    b = boxes(spark, sf_dir)
    w = W.partitionBy("pg").orderBy("x0", "bid")
    b = b.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).withColumn(
        "limit", F.greatest(F.lit(8.0), 3.5 * F.median(F.col("x1") - F.col("x0")).over(W.partitionBy("pg"))))
    return S.islands(b, ["pg"], [F.col("x0"), F.col("bid")], F.col("gap") > F.col("limit"), "part").select("pg", "bid", "part")


@query(
    "j01_contained_tokens",
    f"""WITH {BOXES} SELECT l.pg, l.bid AS native, r.bid AS ocr, ({SHARED}) / ({AREA.format('l')}) AS inside
    FROM b l JOIN b r ON l.pg = r.pg AND l.kind = 'N' AND r.kind <> 'N' WHERE ({SHARED}) > 0.5 * ({AREA.format('l')})""",
)
def contained_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with over half of their own area inside a token of the other source."""
    b = boxes(spark, sf_dir)
    left, right = G.box("l_"), G.box("r_")
    ratio = G.overlap_ratio(left, right)
    pairs = S.spatial_join(S.prefixed(b.where("kind = 'N'"), "l_"), S.prefixed(b.where("kind <> 'N'"), "r_"), ["pg"], ratio > 0.5)
    return pairs.select(F.col("l_pg").alias("pg"), F.col("l_bid").alias("native"), F.col("r_bid").alias("ocr"), ratio.alias("inside"))


FUSION = f"""WITH {BOXES}, m AS (
      SELECT r.pg, r.bid AS ocr, count(l.bid) AS n, string_agg(CAST(l.bid AS VARCHAR), ' ' ORDER BY l.x0, l.bid) AS natives,
             bool_or(l.status = r.status) AS same
      FROM b r LEFT JOIN b l ON l.pg = r.pg AND l.kind = 'N' AND ({SHARED}) > 0.5 * ({AREA.format('l')})
      WHERE r.kind <> 'N' GROUP BY r.pg, r.bid)
    SELECT pg, ocr, coalesce(natives, '') AS natives, CASE WHEN n = 0 THEN 'unmatched' WHEN same THEN 'matched' ELSE 'conflict' END AS outcome FROM m"""


@query("j03_fuse_sources", FUSION)
def fuse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of one source against the other: unmatched, matched or in conflict."""
    b = boxes(spark, sf_dir)
    ocr = b.where("kind <> 'N'")
    left, right = G.box("l_"), G.box("r_")
    pairs = S.spatial_join(S.prefixed(b.where("kind = 'N'"), "l_"), S.prefixed(ocr, "r_"), ["pg"], G.overlap_ratio(left, right) > 0.5)
    found = pairs.groupBy(F.col("r_pg").alias("pg"), F.col("r_bid").alias("ocr")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_x0", "l_bid"))), lambda t: t.l_bid.cast("string")), " ").alias("natives"),
        F.bool_or(F.col("l_status") == F.col("r_status")).alias("same"),
    )
    outcome = F.when(F.col("same").isNull(), "unmatched").when(F.col("same"), "matched").otherwise("conflict")
    return ocr.select("pg", F.col("bid").alias("ocr")).join(found, ["pg", "ocr"], "left").select(
        "pg", "ocr", F.coalesce("natives", F.lit("")).alias("natives"), outcome.alias("outcome"))


@query(
    "j05_assign_regions",
    f"""WITH {BOXES}, r0 AS (SELECT *, bid AS idx FROM b WHERE kind <> 'N'),
    c AS (SELECT l.pg, l.bid AS line, r.bid AS region, ({SHARED}) / ({AREA.format('l')}) AS coverage, {AREA.format('r')} AS area, r.conf, r.idx
          FROM b l JOIN r0 r ON l.pg = r.pg WHERE l.kind = 'N' AND ({SHARED}) > 0.2 * ({AREA.format('l')})),
    m AS (SELECT *, max(coverage) OVER (PARTITION BY pg, line) AS best FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY pg, line ORDER BY area, coalesce(conf, 0) DESC, idx) AS rn FROM m WHERE coverage >= best - 0.05)
    SELECT pg, line, region, coverage FROM k WHERE rn = 1""",
)
def assign_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line to one region: coverage, then the smaller, surer, earlier region."""
    b = boxes(spark, sf_dir)
    left, right = G.box("l_"), G.box("r_")
    cov = G.overlap_ratio(left, right)
    pairs = S.spatial_join(S.prefixed(b.where("kind = 'N'"), "l_"), S.prefixed(b.where("kind <> 'N'"), "r_"), ["pg"], cov > 0.2)
    scored = pairs.select(F.col("l_pg").alias("pg"), F.col("l_bid").alias("line"), F.col("r_bid").alias("region"), cov.alias("coverage"), G.area(right).alias("area"), F.col("r_conf").alias("conf"))
    return S.assign(scored, ["pg", "line"], "coverage", "area", "conf", "region").select("pg", "line", "region", "coverage")


@query(
    "j06_tokens_in_cells",
    f"""WITH {BOXES} SELECT r.pg, r.bid AS cell, count(*) AS tokens, string_agg(CAST(l.bid AS VARCHAR), ' ' ORDER BY l.x0, l.bid) AS ids
    FROM b l JOIN b r ON l.pg = r.pg AND l.kind = 'N' AND r.kind <> 'N'
    WHERE greatest(({SHARED}) / ({AREA.format('l')}), ({SHARED}) / ({AREA.format('r')})) >= 0.35
      AND (l.x0 + l.x1) / 2 BETWEEN r.x0 AND r.x1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY r.pg, r.bid""",
)
def tokens_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    left, right = G.box("l_"), G.box("r_")
    on = (F.greatest(G.overlap_ratio(left, right), G.overlap_ratio(right, left)) >= 0.35) & G.contains_center(right, left)
    pairs = S.spatial_join(S.prefixed(b.where("kind = 'N'"), "l_"), S.prefixed(b.where("kind <> 'N'"), "r_"), ["pg"], on)
    return pairs.groupBy(F.col("r_pg").alias("pg"), F.col("r_bid").alias("cell")).agg(
        F.count(F.lit(1)).alias("tokens"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_x0", "l_bid"))), lambda t: t.l_bid.cast("string")), " ").alias("ids"))


@query(
    "p02_occluded",
    f"""WITH {BOXES} SELECT l.pg, l.bid FROM b l WHERE l.kind = 'N' AND NOT EXISTS (
      SELECT 1 FROM b r WHERE r.pg = l.pg AND r.kind = 'R' AND ({SHARED}) >= 0.35 * ({AREA.format('l')}) AND ({SHARED}) > 0)""",
)
def occluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that no opaque box covers by 35 percent or more."""
    b = boxes(spark, sf_dir)
    chars = b.where("kind = 'N'")
    pairs = S.spatial_join(S.prefixed(chars, "l_"), S.prefixed(b.where("kind = 'R'"), "r_"), ["pg"], G.overlap_ratio(G.box("l_"), G.box("r_")) >= 0.35)
    covered = pairs.select(F.col("l_pg").alias("pg"), F.col("l_bid").alias("bid"))
    return chars.join(covered, ["pg", "bid"], "left_anti").select("pg", "bid")


@query(
    "p01_inside_page",
    f"""WITH {BOXES} SELECT pg, count(*) FILTER (WHERE (x0 + x1) / 2 <= 400 AND (y0 + y1) / 2 <= 60) AS kept,
      count(*) FILTER (WHERE NOT ((x0 + x1) / 2 <= 400 AND (y0 + y1) / 2 <= 60)) AS dropped FROM b GROUP BY pg""",
)
def inside_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = G.contains_center(G.lit_box(*PAGE), G.box())
    return boxes(spark, sf_dir).groupBy("pg").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query(
    "j09_owned_lines",
    f"""WITH {BOXES}, t AS (SELECT l.pg, l.status, l.bid, EXISTS (SELECT 1 FROM b r WHERE r.pg = l.pg AND r.kind <> 'N'
        AND ({SHARED}) >= 0.25 * ({AREA.format('l')}) AND ({SHARED}) > 0) AS inside FROM b l WHERE l.kind = 'N')
    SELECT pg, status, count(*) AS tokens, bool_and(inside) AS owned FROM t GROUP BY pg, status""",
)
def owned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a table's only if every token of it overlaps some cell."""
    b = boxes(spark, sf_dir)
    tokens = b.where("kind = 'N'")
    pairs = S.spatial_join(S.prefixed(tokens, "l_"), S.prefixed(b.where("kind <> 'N'"), "r_"), ["pg"], G.overlap_ratio(G.box("l_"), G.box("r_")) >= 0.25)
    inside = pairs.select(F.col("l_pg").alias("pg"), F.col("l_bid").alias("bid"), F.lit(True).alias("inside")).distinct()
    return tokens.join(inside, ["pg", "bid"], "left").groupBy("pg", "status").agg(
        F.count(F.lit(1)).alias("tokens"), F.bool_and(F.coalesce("inside", F.lit(False))).alias("owned"))


@query(
    "j12_nearest_block",
    f"""WITH {BOXES}, c AS (SELECT l.pg, l.bid AS orphan, r.bid AS block,
        CASE WHEN l.x0 < r.x1 AND r.x0 < l.x1 THEN 0 ELSE 1 END AS apart,
        abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2) AS dy, abs((l.x0 + l.x1) / 2 - (r.x0 + r.x1) / 2) AS dx
      FROM b l JOIN b r ON l.pg = r.pg AND l.kind <> 'N' AND r.kind = 'N'),
    k AS (SELECT *, row_number() OVER (PARTITION BY pg, orphan ORDER BY apart, dy + 0.25 * dx, dx, block) AS rn FROM c)
    SELECT pg, orphan, block, dy + 0.25 * dx AS distance FROM k WHERE rn = 1""",
)
def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orphan table meets the nearest block of its page."""
    b = boxes(spark, sf_dir)
    left, right = S.prefixed(b.where("kind <> 'N'"), "l_"), S.prefixed(b.where("kind = 'N'"), "r_")
    j = left.join(right, F.col("l_pg") == F.col("r_pg"))
    (lx, ly), (rx, ry) = G.center(G.box("l_")), G.center(G.box("r_"))
    dx, dy = F.abs(lx - rx), F.abs(ly - ry)
    apart = (G.axis_overlap(F.col("l_x0"), F.col("l_x1"), F.col("r_x0"), F.col("r_x1")) <= 0).cast("int")
    best = F.min(F.struct(apart.alias("apart"), (dy + 0.25 * dx).alias("distance"), dx.alias("dx"), F.col("r_bid").alias("block")))
    return j.groupBy(F.col("l_pg").alias("pg"), F.col("l_bid").alias("orphan")).agg(best.alias("m")).select("pg", "orphan", "m.block", "m.distance")


@query(
    "j14_adjacent_pages",
    f"""WITH {BOXES}, t AS (SELECT pg // 10 AS doc, pg % 10 AS page, kind, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM b GROUP BY ALL),
    s AS (SELECT p.doc, p.page, p.kind, f.page AS next_page,
        3 + CASE WHEN p.n = f.n THEN 3 ELSE 0 END + CASE WHEN abs(p.x0 - f.x0) <= 100 THEN 2 ELSE 0 END + CASE WHEN abs(p.x1 - f.x1) <= 100 THEN 2 ELSE 0 END AS score
      FROM t p JOIN t f ON p.doc = f.doc AND f.page = p.page + 1 AND p.kind = f.kind)
    SELECT doc, page, kind, next_page, score FROM s WHERE score >= 7""",
)
def adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table fragments joined over the page break by an additive score of 7 or more."""
    b = boxes(spark, sf_dir).withColumns({"doc": F.expr("pg div 10"), "page": F.col("pg") % 10})
    t = b.groupBy("doc", "page", "kind").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))
    f = t.select("doc", "kind", (F.col("page") - 1).alias("page"), F.col("x0").alias("f0"), F.col("x1").alias("f1"), F.col("n").alias("fn"))
    score = 3 + F.when(F.col("n") == F.col("fn"), 3).otherwise(0) + F.when(F.abs(F.col("x0") - F.col("f0")) <= 100, 2).otherwise(0) + F.when(F.abs(F.col("x1") - F.col("f1")) <= 100, 2).otherwise(0)
    return t.join(f, ["doc", "kind", "page"]).select("doc", "page", "kind", (F.col("page") + 1).alias("next_page"), score.alias("score")).where("score >= 7")


@query(
    "k05_reading_index",
    f"WITH {BOXES} SELECT pg, bid, CAST(row_number() OVER (PARTITION BY pg ORDER BY y0, x0, bid) - 1 AS INTEGER) AS order_index FROM b",
)
def reading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense_order(boxes(spark, sf_dir), ["pg"], [F.col("y0"), F.col("x0"), F.col("bid")]).select("pg", "bid", "order_index")


@query(
    "k04_native_order",
    f"""WITH {BOXES}, l AS (SELECT pg, y0, lag(y0) OVER (PARTITION BY pg ORDER BY bid) AS before FROM b)
    SELECT pg, avg(CASE WHEN y0 >= before - 0.75 THEN 1.0 ELSE 0.0 END) FILTER (WHERE before IS NOT NULL) AS consistency
    FROM l GROUP BY pg HAVING count(*) >= 3""",
)
def native_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of plausible steps in source order, for pages of three lines or more."""
    b = boxes(spark, sf_dir).withColumn("before", F.lag("y0").over(W.partitionBy("pg").orderBy("bid")))
    ok = F.when(F.col("before").isNotNull(), (F.col("y0") >= F.col("before") - 0.75).cast("double"))
    return b.groupBy("pg").agg(F.avg(ok).alias("consistency"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


@query(
    "k06_insert_after",
    f"""WITH {BOXES}, blocks AS (SELECT pg, bid AS block, max(bid) AS last FROM b WHERE kind = 'N' GROUP BY pg, bid),
    f AS (SELECT pg, bid FROM b WHERE kind <> 'N')
    SELECT f.pg, f.bid, (SELECT max(block) FROM blocks k WHERE k.pg = f.pg AND k.last < f.bid) AS after FROM f""",
)
def insert_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: a fallback follows the last block before it, by one ordered pass."""
    b = boxes(spark, sf_dir)
    w = W.partitionBy("pg").orderBy("bid").rowsBetween(W.unboundedPreceding, -1)
    return b.withColumn("after", F.last(F.when(F.col("kind") == "N", F.col("bid")), ignorenulls=True).over(w)).where("kind <> 'N'").select("pg", "bid", "after")


@query(
    "k07_ownership",
    f"""WITH {BOXES}, p AS (SELECT pg, x0, bid, kind, CASE kind WHEN 'R' THEN 300 WHEN 'A' THEN 200 ELSE 50 END AS priority FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY pg // 8, x0 ORDER BY priority DESC, pg, bid) AS rn FROM p)
    SELECT pg // 8 AS doc, x0 AS line, pg, bid, rn = 1 AS wins FROM k""",
)
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several claims on one line the highest priority wins, then the first."""
    priority = F.when(F.col("kind") == "R", 300).when(F.col("kind") == "A", 200).otherwise(50)
    w = W.partitionBy("doc", "x0").orderBy(priority.desc(), "pg", "bid")
    return boxes(spark, sf_dir).withColumn("doc", F.expr("pg div 8")).select("doc", F.col("x0").alias("line"), "pg", "bid", (F.row_number().over(w) == 1).alias("wins"))
