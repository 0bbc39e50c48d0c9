"""Page complexity, region decisions, line roles, headings and recogniser quality over
synthetic pages: forty orders are a page, their line items its boxes."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import cascades as C
from ..functions import geometry as G
from ..functions import text as T
from ..operators import spatial as S
from ..operators.layout import Box, iou
from .base import AREA, BOXES, SHARED, boxes, table
from .geometry import SLABS
from .registry import query

PAGE = (0.0, 0.0, 550.0, 750.0)
#: x and y at two scales, so that some pages are dense, and lines of every height
PAGES = f"""{BOXES}, e AS (SELECT pg // 40 AS pg, pg * 10 + bid AS bid, x0, y0, x1, y1, kind, status, conf, CASE kind WHEN 'N' THEN 'ab' || bid WHEN 'A' THEN 'fig' || bid ELSE '' || pg END AS text FROM b)"""
PAGE_AREA = (PAGE[2] - PAGE[0]) * (PAGE[3] - PAGE[1])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("bid").cast("string"), F.col("pg").cast("string")
    text = F.when(F.col("kind") == "N", F.concat(F.lit("ab"), n)).when(F.col("kind") == "A", F.concat(F.lit("fig"), n)).otherwise(p)
    return boxes(spark, sf_dir).select(
        F.expr("pg div 40").alias("pg"), (F.col("pg") * 10 + F.col("bid")).alias("bid"), "x0", "y0", "x1", "y1", "kind", "status", "conf", text.alias("text"))


GRID = """g AS (SELECT pg, count(*) FILTER (WHERE y1 - y0 <= 4 AND x1 - x0 >= 0.2 * 550) AS h, count(*) FILTER (WHERE x1 - x0 <= 4 AND y1 - y0 >= 0.12 * 750) AS v,
  count(*) AS n, count(*) FILTER (WHERE (x0 + x1) / 2 < 275) AS nl, count(*) FILTER (WHERE (x0 + x1) / 2 >= 275) AS nr, max(x1) FILTER (WHERE (x0 + x1) / 2 < 275) AS le, min(x0) FILTER (WHERE (x0 + x1) / 2 >= 275) AS rs FROM r GROUP BY pg)"""


@query(
    "p07_p08_page_signals",
    f"""WITH {PAGES}, r AS (SELECT pg, bid, CASE WHEN bid % 3 = 0 THEN x0 * 0.5 ELSE 300 + x0 * 0.4 END AS x0, y0, CASE WHEN bid % 3 = 0 THEN x0 * 0.5 + CASE WHEN bid % 9 = 0 THEN 2 ELSE 15 END ELSE 300 + x0 * 0.4 + CASE WHEN bid % 7 = 0 THEN 120 ELSE 9 END END AS x1,
      y0 + CASE WHEN bid % 9 = 0 THEN 100 WHEN bid % 7 = 0 THEN 3 ELSE 10 END AS y1 FROM e), {GRID}
    SELECT pg, CASE WHEN h >= 2 AND v >= 2 THEN h + v ELSE 0 END AS grid_lines, coalesce(n >= 120 AND (CASE WHEN h >= 2 AND v >= 2 THEN h + v ELSE 0 END) < 4 AND nl >= 0.2 * n AND nr >= 0.2 * n AND rs - le > 0.06 * 550, FALSE) AS two_columns FROM g""",
)
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, page = F.col("bid"), G.lit_box(*PAGE)
    x0 = F.when(n % 3 == 0, F.col("x0") * 0.5).otherwise(300 + F.col("x0") * 0.4)
    wide = F.when(n % 3 == 0, F.when(n % 9 == 0, 2).otherwise(15)).otherwise(F.when(n % 7 == 0, 120).otherwise(9))
    r = evidence(spark, sf_dir).select("pg", x0.alias("x0"), "y0", (x0 + wide).alias("x1"), (F.col("y0") + F.when(n % 9 == 0, 100).when(n % 7 == 0, 3).otherwise(10)).alias("y1"))
    b = G.box()
    left = G.center(b)[0] < 275
    m = r.groupBy("pg").agg(
        F.count_if(C.is_horizontal_rule(b, page)).alias("h"), F.count_if(C.is_vertical_rule(b, page)).alias("v"), F.count(F.lit(1)).alias("n"),
        F.count_if(left).alias("nl"), F.count_if(~left).alias("nr"), F.max(F.when(left, b.x1)).alias("le"), F.min(F.when(~left, b.x0)).alias("rs"))
    grid = C.grid_lines(F.col("h"), F.col("v"))
    return m.select("pg", grid.alias("grid_lines"), C.two_columns(*[F.col(c) for c in ("n", "nl", "nr", "le", "rs")], F.lit(550.0), grid).alias("two_columns"))


@query(
    "p05_p06_p09_page_complexity",
    f"""WITH {PAGES}, {SLABS.format(k='pg', ks='s.pg', t='t').replace('solid', 'ts').replace('union_area', 'ua').replace('e AS (', 'te AS (').replace('FROM e)', 'FROM te)').replace(' s AS', ' tsl AS').replace('FROM s JOIN', 'FROM tsl s JOIN').replace(' i AS', ' ti AS').replace('FROM i)', 'FROM ti)').replace(' m AS', ' tm AS').replace('FROM m GROUP', 'FROM tm GROUP').replace(' a AS', ' ta AS').replace('ts AS (SELECT', "t AS (SELECT * FROM e WHERE kind = 'N'), ts AS (SELECT", 1)},
    {SLABS.format(k='pg', ks='s.pg', t='im').replace('solid', 'ms').replace('union_area', 'ua').replace('e AS (', 'me AS (').replace('FROM e)', 'FROM me)').replace(' s AS', ' msl AS').replace('FROM s JOIN', 'FROM msl s JOIN').replace(' i AS', ' mi AS').replace('FROM i)', 'FROM mi)').replace(' m AS', ' mm AS').replace('FROM m GROUP', 'FROM mm GROUP').replace(' a AS', ' ma AS').replace('ms AS (SELECT', "im AS (SELECT * FROM e WHERE kind = 'R'), ms AS (SELECT", 1)},
    g AS (SELECT pg, coalesce(sum(length(text)) FILTER (WHERE kind = 'N'), 0) AS useful, max((x1 - x0) * (y1 - y0)) FILTER (WHERE kind = 'R') / {PAGE_AREA} AS largest, count(*) FILTER (WHERE kind = 'A' AND bid % 50 = 0) AS annotations FROM e GROUP BY pg),
    p AS (SELECT g.pg, useful, coalesce(largest, 0) AS largest, annotations, least(1, coalesce(ma.ua, 0) / {PAGE_AREA}) AS images, least(1, coalesce(ta.ua, 0) / {PAGE_AREA}) AS cover FROM g LEFT JOIN ma USING (pg) LEFT JOIN ta USING (pg)),
    q AS (SELECT *, useful = 0 AS no_text, (useful <= 30 AND largest >= 0.75) OR (useful = 0 AND images >= 0.4) AS scanned, useful < 80 AND images >= 0.05 AS sparse, annotations > 0 AND useful < 80 AS annotated FROM p)
    SELECT pg, concat_ws(',', CASE WHEN no_text THEN 'no_text' END, CASE WHEN scanned THEN 'scanned' END, CASE WHEN sparse THEN 'sparse_text' END, CASE WHEN annotated THEN 'annotation_text' END, CASE WHEN images >= 0.05 THEN 'embedded_images' END) AS reasons,
      CASE WHEN no_text OR scanned THEN 'ocr_candidate' WHEN sparse OR annotated OR images >= 0.05 THEN 'hybrid_candidate' ELSE 'native' END AS strategy,
      round(greatest(0, least(1, 1 - CASE WHEN useful = 0 THEN 0.8 WHEN cover < 0.002 THEN 0.1 ELSE 0 END - CASE WHEN sparse THEN 0.2 ELSE 0 END - CASE WHEN no_text THEN 0.7 ELSE 0 END - CASE WHEN scanned THEN 0.8 ELSE 0 END - CASE WHEN annotated THEN 0.15 ELSE 0 END)), 6) AS score,
      round(images, 6) AS image_coverage, round(cover, 6) AS text_coverage FROM q""",
)
def page_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, strategy and native score of every page from its aggregates."""
    e = evidence(spark, sf_dir)
    cover = lambda kind, name: S.union_area(e.where(F.col("kind") == kind), ["pg"]).select("pg", F.least(F.lit(1.0), F.col("union_area") / PAGE_AREA).alias(name))
    is_kind = lambda k: F.col("kind") == k
    m = e.groupBy("pg").agg(
        F.coalesce(F.sum(F.when(is_kind("N"), F.length("text"))), F.lit(0)).alias("useful"), F.coalesce(F.max(F.when(is_kind("R"), G.area(G.box()))) / PAGE_AREA, F.lit(0.0)).alias("largest_image"),
        F.count_if(is_kind("A") & (F.col("bid") % 50 == 0)).alias("annotations"))
    m = m.join(cover("R", "image_coverage"), "pg", "left").join(cover("N", "text_coverage"), "pg", "left").fillna(0.0, ["image_coverage", "text_coverage"])
    none = {k: F.lit(0) for k in ("replacement", "private_use", "control", "unmapped", "duplicates", "invisible_lines", "lines", "paths", "path_coverage", "grid")}
    p = none | {k: F.col(k) for k in ("useful", "largest_image", "annotations", "image_coverage", "text_coverage")} | {"ink": F.lit(None).cast("double"), "rotated": F.lit(False), "two_columns": F.lit(False)}
    m = m.withColumn("reasons", C.page_reasons(p))
    score = C.native_text_score(F.col("reasons"), F.col("useful"), F.col("text_coverage"), F.lit(0.0), F.lit(0.0))
    return m.select(
        "pg", F.array_join("reasons", ",").alias("reasons"), C.strategy(F.col("reasons"), p["ink"]).alias("strategy"), F.round(score, 6).alias("score"),
        F.round("image_coverage", 6).alias("image_coverage"), F.round("text_coverage", 6).alias("text_coverage"))


@query(
    "p10_region_decisions",
    f"""WITH {PAGES}, r AS (SELECT pg, bid, CASE bid % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'header' ELSE 'text' END AS kind, CASE WHEN bid % 3 = 0 THEN '' ELSE text END AS t,
      (x1 - x0) * (y1 - y0) * CASE WHEN bid % 20 = 0 THEN 5000 ELSE 1 END AS area, conf AS coverage, CASE WHEN bid % 11 = 0 THEN 0.001 ELSE 0.5 END AS ink, status = 'O' AND bid % 7 = 0 AS unmapped, pg % 2 = 0 AS damaged FROM e)
    SELECT pg, bid, CASE WHEN kind IN ('figure', 'table') AND area / {PAGE_AREA} >= 0.6 AND length(t) < 40 AND ink >= 0.008 THEN 'escalate_page_ocr' WHEN kind = 'figure' AND ink >= 0.008 AND t = '' THEN 'ocr_region' WHEN kind = 'figure' AND ink >= 0.008 THEN 'merge_ocr'
        WHEN kind = 'table' AND ink >= 0.008 AND (t = '' OR coverage < 0.008) THEN 'ocr_region' WHEN t = '' AND ink >= 0.008 AND kind <> 'header' THEN 'ocr_region' WHEN t <> '' AND ink < 0.008 THEN 'keep_native' WHEN unmapped THEN 'merge_ocr'
        WHEN t <> '' AND damaged THEN 'merge_ocr' ELSE 'keep_native' END AS decision,
      CAST(CASE WHEN kind IN ('figure', 'table') AND area / {PAGE_AREA} >= 0.6 AND length(t) < 40 AND ink >= 0.008 THEN 0.9 WHEN kind = 'figure' AND ink >= 0.008 AND t = '' THEN 0.82 WHEN kind = 'figure' AND ink >= 0.008 THEN 0.72
        WHEN kind = 'table' AND ink >= 0.008 AND (t = '' OR coverage < 0.008) THEN 0.84 WHEN t = '' AND ink >= 0.008 AND kind <> 'header' THEN 0.78 WHEN t <> '' AND ink < 0.008 THEN 0.55 WHEN unmapped THEN 0.64
        WHEN t <> '' AND damaged THEN 0.68 WHEN t <> '' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM r""",
)
def region_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bid")
    r = evidence(spark, sf_dir).select(
        "pg", "bid", F.when(n % 5 == 0, "figure").when(n % 5 == 1, "table").when(n % 5 == 2, "header").otherwise("text").alias("k"), F.when(n % 3 == 0, "").otherwise(F.col("text")).alias("t"),
        (G.area(G.box()) * F.when(n % 20 == 0, 5000).otherwise(1)).alias("area"), F.col("conf").alias("coverage"), F.when(n % 11 == 0, 0.001).otherwise(0.5).alias("ink"), ((F.col("status") == "O") & (n % 7 == 0)).alias("unmapped"),
        F.when(F.col("pg") % 2 == 0, F.array(F.lit("garbled_unicode"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    d = C.region_decision(*[F.col(c) for c in ("k", "t", "area")], F.lit(PAGE_AREA), *[F.col(c) for c in ("coverage", "ink", "unmapped", "reasons")], F.lit(0.6))
    return r.select("pg", "bid", d.alias("d")).select("pg", "bid", "d.decision", F.round("d.confidence", 6).alias("confidence"))


@query(
    "p10_page_promotion",
    f"""WITH {PAGES}, {SLABS.format(k='pg', ks='s.pg', t='al').replace('solid AS (SELECT', 'al AS (SELECT * FROM e), solid AS (SELECT', 1).replace('e AS (SELECT DISTINCT', 'e2 AS (SELECT DISTINCT').replace('FROM e)', 'FROM e2)', 2).replace('al AS (SELECT * FROM e2)', 'al AS (SELECT * FROM e)')},
    {SLABS.format(k='pg', ks='s.pg', t='bad').replace('solid AS (SELECT', "bad AS (SELECT * FROM e WHERE kind <> 'N'), bsolid AS (SELECT", 1).replace('FROM solid', 'FROM bsolid').replace('JOIN solid', 'JOIN bsolid').replace(' e AS (SELECT DISTINCT', ' be AS (SELECT DISTINCT').replace(' s AS (SELECT', ' bs AS (SELECT').replace('OVER (PARTITION BY pg ORDER BY sx) AS ex FROM e)', 'OVER (PARTITION BY pg ORDER BY sx) AS ex FROM be)').replace('FROM s JOIN', 'FROM bs s JOIN').replace(' i AS (', ' bi AS (').replace('FROM i)', 'FROM bi)').replace(' m AS (', ' bm AS (').replace('FROM m GROUP', 'FROM bm GROUP').replace(' a AS (', ' ba AS (')},
    n AS (SELECT pg, count(*) AS regions, count(*) FILTER (WHERE kind <> 'N') AS bad FROM e GROUP BY pg)
    SELECT pg, round(bad / CAST(regions AS DOUBLE), 6) AS bad_region_ratio, round(least(1, coalesce(ba.union_area, 0) / greatest(a.union_area, 1)), 6) AS bad_area_ratio,
      bad >= 0.6 * regions AND coalesce(ba.union_area, 0) >= 0.6 * greatest(a.union_area, 1) AS promote FROM n JOIN a USING (pg) LEFT JOIN ba USING (pg)""",
)
def page_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages most of whose regions, by number and by area, need recognition."""
    e = evidence(spark, sf_dir)
    bad = F.col("kind") != "N"
    m = e.groupBy("pg").agg(F.count(F.lit(1)).alias("regions"), F.count_if(bad).alias("bad"))
    m = m.join(S.union_area(e, ["pg"]), "pg").join(S.union_area(e.where(bad), ["pg"]).withColumnRenamed("union_area", "bad_area"), "pg", "left").fillna(0.0, ["bad_area"])
    c = [F.col(x) for x in ("regions", "bad", "union_area", "bad_area")]
    return m.select("pg", F.round(c[1] / c[0], 6).alias("bad_region_ratio"), F.round(F.least(F.lit(1.0), c[3] / F.greatest(c[2], F.lit(1.0))), 6).alias("bad_area_ratio"), C.promotes_page(*c, F.lit(False), F.lit(False)).alias("promote"))


TOKENS = f"""{PAGES}, k AS (SELECT pg, bid, x0, y0, x1, y1, text, greatest(0, least(1, 0.9973 - conf * CASE WHEN pg % 3 = 0 THEN 6 ELSE 1 END)) AS c, CASE WHEN bid % 4 = 0 THEN 90 ELSE 0 END AS rot,
   greatest(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]'))) AS w, length(text) AS n FROM e)"""


@query(
    "p16_p24_quality_gate",
    f"""WITH {TOKENS}, m AS (SELECT pg, count(*) AS tokens, sum(c * w) / sum(w) AS weighted, quantile_cont(c, 0.25) AS quartile, median(c) AS med, sum(CASE WHEN c < 0.7 THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE) AS low,
      avg(CASE WHEN n <= 1 OR (rot = 90 AND y1 - y0 >= 1.15 * (x1 - x0)) OR (rot = 0 AND x1 - x0 >= 1.15 * (y1 - y0)) THEN 1.0 ELSE 0.0 END) AS oriented FROM k GROUP BY pg),
    r AS (SELECT *, concat_ws(',', CASE WHEN weighted < 0.7 THEN 'low_weighted_confidence' END, CASE WHEN quartile < 0.78 THEN 'weak_lower_quartile' END, CASE WHEN low > 0.12 THEN 'low_confidence_characters' END, CASE WHEN low >= 0.35 THEN 'severely_low_confidence_characters' END,
      CASE WHEN oriented < 0.75 THEN 'orientation_ratio_below_threshold' END) AS reasons FROM m)
    SELECT pg, tokens, round(weighted, 6) AS weighted, round(quartile, 6) AS quartile, round(med, 6) AS median_confidence, round(low, 6) AS low_ratio, reasons, reasons = '' AND weighted >= 0.9 AS sufficient,
      round(CASE WHEN reasons = '' AND weighted >= 0.9 THEN least(1, weighted + 0.04 + 0.02 * oriented) ELSE greatest(0, weighted - 0.08 * low) END, 6) AS score FROM r""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's tokens are good enough, why not, and a score for ranking."""
    return assess(page_tokens(spark, sf_dir), ["pg"]).select(
        "pg", "tokens", F.round("weighted", 6).alias("weighted"), F.round("quartile", 6).alias("quartile"), F.round("median", 6).alias("median_confidence"), F.round("low_ratio", 6).alias("low_ratio"),
        F.array_join("reasons", ",").alias("reasons"), "sufficient", F.round("score", 6).alias("score"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.9973 - F.col("conf") * F.when(F.col("pg") % 3 == 0, 6).otherwise(1)))
    return evidence(spark, sf_dir).withColumns({"confidence": c, "rotation": F.when(F.col("bid") % 4 == 0, 90).otherwise(0)})


def assess(tokens: DataFrame, keys: list[str], thresholds: dict[str, float] = C.THRESHOLDS) -> DataFrame:
    """One row per group of tokens (text, box, confidence, rotation) with the metrics,
    reasons, sufficient and score of the quality gate. A null confidence is 0."""
    t = F.col("text")
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    b = G.box()
    count = lambda p: F.regexp_count(t, F.lit(p))
    n = F.length(t)
    m = tokens.withColumns({"_c": c, "_w": F.greatest(F.lit(1), count(r"[\p{L}\p{N}]")), "_s": T.suspicious(t, G.area(b), F.col("confidence")), "_o": T.orientation_plausible(t, G.width(b), G.height(b), F.col("rotation"))})
    share = lambda x: F.avg(x.cast("double"))
    # a sum of doubles depends on the order of rows in its last digits, one of whole 2^-62 does not
    units = F.floor(F.col("_c") * 2.0**62).cast("decimal(20,0)")
    m = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(n).alias("chars"), ((F.sum(units * F.col("_w")) / F.sum("_w")).cast("double") / 2.0**62).alias("weighted"), F.percentile("_c", 0.25).alias("quartile"), F.median("_c").alias("median"),
        (F.sum(F.when(F.col("_c") < thresholds["low"], F.col("_w")).otherwise(0)) / F.sum("_w")).alias("low_ratio"), share(F.col("_s")).alias("suspicious"), share(F.col("_o")).alias("oriented"),
        (1 - F.sum(count(r"[\p{C}\p{Z}&&[^ ]]")) / F.greatest(F.sum(n), F.lit(1))).alias("printable"), (F.sum(count(r"\p{C}")) / F.greatest(F.sum(n), F.lit(1))).alias("control"))
    p = {k: F.col(k) for k in ("tokens", "weighted", "quartile", "low_ratio", "suspicious", "oriented", "printable", "control")} | {"yield": F.lit(1.0), "incoherent": F.lit(False)}
    m = m.withColumn("reasons", C.quality_reasons(p, thresholds))
    m = m.withColumn("sufficient", (F.size("reasons") == 0) & (F.col("weighted") >= thresholds["strong_mean"]))
    return m.withColumn("score", C.quality_score(p, F.col("sufficient")))


@query(
    "a21_f20_candidate_scores",
    f"""WITH {TOKENS}, d AS (SELECT *, row_number() OVER (PARTITION BY pg, text ORDER BY bid) AS rep, row_number() OVER (PARTITION BY pg ORDER BY c) AS rn, count(*) OVER (PARTITION BY pg) AS cnt,
      len(regexp_extract_all(text, '\\p{{L}}')) AS le, len(regexp_extract_all(text, '[0-9]')) AS di FROM k),
    m AS (SELECT pg, avg(c) AS mean, max(c) FILTER (WHERE rn = (cnt - 1) // 4 + 1) AS quartile, avg(CASE WHEN c < 0.6 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN rep > 1 THEN 1.0 ELSE 0.0 END) AS dup, avg(CASE WHEN x1 - x0 >= y1 - y0 THEN 1.0 ELSE 0.0 END) AS horiz,
      avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS ins, sum(n) AS chars, count(*) FILTER (WHERE le >= 2 AND le / CAST(n AS DOUBLE) >= 0.5) AS good, count(*) FILTER (WHERE NOT (di > 0 AND le = 0)) AS judged FROM d GROUP BY pg)
    SELECT pg, round(mean + least(0.08, ln(1 + chars) * 0.012) + horiz * 0.02 + quartile * 0.05 + 0.03 * CASE WHEN judged = 0 THEN 0.5 ELSE good / CAST(judged AS DOUBLE) END - low * 0.15 - dup * 0.10 - ins * 0.08, 6) AS score,
      round(dup, 6) AS duplicate_ratio, round(quartile, 6) AS lower_quartile FROM m""",
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = candidate_statistics(page_tokens(spark, sf_dir), ["pg"])
    return s.select("pg", F.round("score", 6).alias("score"), F.round("duplicates", 6).alias("duplicate_ratio"), F.round("quartile", 6).alias("lower_quartile"))


def candidate_statistics(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics and score of candidate readings, one row per group of tokens.

    Repeats are counted per text first. Tokens with a flat box and those without a
    confidence have no part in the statistics of confidence."""
    t, b = F.col("text"), G.box()
    flat = G.area(b) <= 0
    plausible, neutral = C.lexical_plausibility(t)
    c = F.when(~flat, F.col("confidence"))
    w = W.partitionBy(*keys)
    ranked = tokens.withColumns({"_c": c, "_n": F.count(c).over(w)})
    ranked = ranked.withColumn("_r", F.when(F.col("_c").isNotNull(), F.row_number().over(w.orderBy(F.col("_c").asc_nulls_last()))))
    share = lambda x: F.avg(x.cast("double"))
    at = F.floor((F.col("_n") - 1) / 4) + 1
    bad = F.regexp_count(t, F.lit(r"[\x{FFFD}\p{C}&&[^ \t\n]]"))
    m = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"), F.coalesce(F.avg("_c"), F.lit(0.0)).alias("mean"), F.coalesce(F.max(F.when(F.col("_r") == at, F.col("_c"))), F.lit(0.0)).alias("quartile"),
        F.coalesce(F.avg(F.when(F.col("_c").isNotNull(), (F.col("_c") < 0.6).cast("double"))), F.lit(0.0)).alias("low"), share(G.width(b) >= G.height(b)).alias("horizontal"), share(flat).alias("invalid"),
        share((F.length(F.trim(t)) <= 1) | t.contains("�")).alias("insertions"), F.sum(F.length(F.trim(t))).alias("chars"), (F.sum(bad) / F.greatest(F.sum(F.length(t)), F.lit(1))).alias("bad_chars"),
        F.count_if(plausible).alias("_p"), F.count_if(~neutral).alias("_j"))
    texts = tokens.where(F.trim("text") != "").groupBy(*keys, F.trim("text").alias("_t")).agg(F.count(F.lit(1)).alias("_k"))
    m = m.join(texts.groupBy(*keys).agg((F.sum(F.col("_k") - 1) / F.sum("_k")).alias("duplicates")), keys, "left").fillna(0.0, ["duplicates"])
    m = m.withColumn("lexical", F.when(F.col("_j") == 0, 0.5).otherwise(F.col("_p") / F.col("_j"))).drop("_p", "_j")
    names = ("mean", "chars", "horizontal", "quartile", "lexical", "low", "bad_chars", "duplicates", "invalid", "insertions")
    return m.withColumn("score", C.candidate_score({k: F.col(k) for k in names}))


@query(
    "j17_k09_candidate_ranking",
    f"""WITH {TOKENS}, base AS (SELECT * FROM k WHERE c >= 0.7), cand AS (SELECT pg, bid, bid % 3 AS cand, x0 + CASE WHEN bid % 5 = 0 THEN 30 ELSE 0.1 END AS x0, y0, x1 + CASE WHEN bid % 5 = 0 THEN 30 ELSE 0.1 END AS x1, y1, text FROM k),
    n AS (SELECT pg, count(*) AS n FROM base GROUP BY pg), cs AS (SELECT pg, unnest([0, 1, 2]) AS cand FROM (SELECT DISTINCT pg FROM k)),
    h AS (SELECT DISTINCT r.cand, l.pg, l.bid FROM base l JOIN cand r ON l.pg = r.pg AND lower(l.text) = lower(r.text) WHERE ({SHARED}) > 0 AND ({SHARED}) / (({AREA.format('l')}) + ({AREA.format('r')}) - ({SHARED})) >= 0.25),
    p AS (SELECT cs.pg, cs.cand, CASE WHEN n.n IS NULL THEN 1.0 ELSE count(h.bid) / CAST(any_value(n.n) AS DOUBLE) END AS preserved FROM cs LEFT JOIN n USING (pg) LEFT JOIN h ON h.pg = cs.pg AND h.cand = cs.cand GROUP BY cs.pg, cs.cand, n.n)
    SELECT pg, CAST(cand AS BIGINT) AS cand, round(preserved, 6) AS preserved, round(1 - greatest(0, 0.8 - preserved) * 0.45, 6) AS score, row_number() OVER (PARTITION BY pg ORDER BY 1 - greatest(0, 0.8 - preserved) * 0.45 DESC, cand) AS place FROM p""",
)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the trusted baseline each candidate keeps, and its place by the
    score less what it lost."""
    k = page_tokens(spark, sf_dir)
    move = F.when(F.col("bid") % 5 == 0, 30.0).otherwise(0.1)
    cand = k.withColumns({"cand": F.col("bid") % 3, "x0": F.col("x0") + move, "x1": F.col("x1") + move})
    p = preservation(k.where("confidence >= 0.7"), cand, ["pg"], "cand", k.select("pg").distinct().withColumn("cand", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))))
    score = 1 - F.greatest(F.lit(0.0), 0.8 - F.col("preserved")) * 0.45
    return p.select("pg", "cand", F.round("preserved", 6).alias("preserved"), F.round(score, 6).alias("score"), F.row_number().over(W.partitionBy("pg").orderBy(score.desc(), "cand")).alias("place"))


def preservation(baseline: DataFrame, candidates: DataFrame, keys: list[str], name: str, every: DataFrame) -> DataFrame:
    """keys, name, preserved: the share of the baseline's tokens that a candidate has
    with the same text, case and spaces aside, at an IoU of 0.25 or more; 1 without a
    baseline. ``every`` lists the candidates."""
    key = F.regexp_replace(F.trim(T.casefold("text")), r"(?U)\s+", " ")
    left = S.prefixed(baseline.withColumn("key", key).select(*keys, "bid", "x0", "y0", "x1", "y1", "key"), "l_")
    right = S.prefixed(candidates.withColumn("key", key).select(*keys, name, "x0", "y0", "x1", "y1", "key"), "r_")
    hit = S.spatial_join(left, right, [*keys, "key"], G.iou(G.box("l_"), G.box("r_")) >= 0.25)
    hit = hit.select(*[F.col(f"l_{k}").alias(k) for k in keys], F.col(f"r_{name}").alias(name), "l_bid").distinct().groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_hit"))
    n = baseline.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = every.join(n, keys, "left").join(hit, [*keys, name], "left")
    return out.select(*keys, name, F.when(F.col("_n").isNull(), 1.0).otherwise(F.coalesce("_hit", F.lit(0)) / F.col("_n")).alias("preserved"))


@query(
    "a22_duplicate_boxes",
    f"""WITH {PAGES}, u AS (SELECT pg, bid, x0, y0, x1, y1, text FROM e UNION ALL SELECT pg, bid + 1000000000, x0 + CASE WHEN bid % 2 = 0 THEN 0.05 ELSE 9 END, y0, x1 + CASE WHEN bid % 2 = 0 THEN 0.05 ELSE 9 END, y1, text FROM e WHERE bid % 3 = 0)
    SELECT pg, count(DISTINCT bid) AS duplicates FROM (SELECT r.pg, r.bid FROM u l JOIN u r ON l.pg = r.pg AND l.bid < r.bid AND l.text = r.text
      WHERE ({SHARED}) > 0 AND ({SHARED}) / (({AREA.format('l')}) + ({AREA.format('r')}) - ({SHARED})) >= 0.85) GROUP BY pg""",
)
def duplicate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters equal to an earlier one in text and, nearly, in place."""
    e = evidence(spark, sf_dir).select("pg", "bid", "x0", "y0", "x1", "y1", "text")
    move = F.when(F.col("bid") % 2 == 0, 0.05).otherwise(9.0)
    again = e.where("bid % 3 = 0").withColumns({"bid": F.col("bid") + 1_000_000_000, "x0": F.col("x0") + move, "x1": F.col("x1") + move})
    return duplicates(e.unionByName(again), ["pg"], "bid").groupBy("pg").agg(F.count(F.lit(1)).alias("duplicates"))


def duplicates(chars: DataFrame, keys: list[str], order: str, iou: float = 0.85) -> DataFrame:
    """keys and order of the characters that repeat an earlier one: same text, high
    IoU. The text is a key of the join, so only equal characters meet."""
    on = (F.col(f"l_{order}") < F.col(f"r_{order}")) & (G.iou(G.box("l_"), G.box("r_")) >= iou)
    pairs = S.spatial_join(S.prefixed(chars, "l_"), S.prefixed(chars, "r_"), [*keys, "text"], on)
    return pairs.select(*[F.col(f"r_{k}").alias(k) for k in [*keys, order]]).distinct()


@query(
    "a20_coverage",
    f"""WITH {PAGES}, {SLABS.format(k='pg', ks='s.pg', t='e0').replace('solid AS (SELECT', 'e0 AS (SELECT * FROM e), solid AS (SELECT', 1).replace('e AS (SELECT DISTINCT', 'e9 AS (SELECT DISTINCT').replace('AS ex FROM e)', 'AS ex FROM e9)')},
    d AS (SELECT l.pg, count(DISTINCT l.bid) AS dup FROM e l JOIN e r ON l.pg = r.pg AND l.bid < r.bid AND lower(l.text) = lower(r.text) WHERE ({SHARED}) / (({AREA.format('l')}) + ({AREA.format('r')}) - ({SHARED})) >= 0.70 GROUP BY l.pg),
    n AS (SELECT pg, count(*) AS tokens, sum(length(text)) AS chars FROM e GROUP BY pg)
    SELECT pg, tokens, CAST(chars AS BIGINT) AS chars, round(union_area / {PAGE_AREA}, 8) AS area_coverage, round(coalesce(dup, 0) / CAST(tokens AS DOUBLE), 8) AS duplicate_ratio FROM n JOIN a USING (pg) LEFT JOIN d USING (pg)""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, characters and repeats of a reading; of a pair of repeats the earlier counts."""
    e = evidence(spark, sf_dir).where((F.trim("text") != "") & (G.area(G.box()) > 0))
    n = e.groupBy("pg").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(F.length("text")).alias("chars"), F.collect_list(F.struct("bid", "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("_b"))
    boxes = [F.col(f"_b.{c}") for c in ("x0", "y0", "x1", "y1")]
    dup, area = repeated(F.col("_b.bid"), F.col("_b.text"), *boxes), S.area_of(*boxes)
    return n.where("pg IS NOT NULL").select("pg", "tokens", "chars", F.round(area / PAGE_AREA, 8).alias("area_coverage"), F.round(dup / F.col("tokens"), 8).alias("duplicate_ratio"))


WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def repeats_of_page(bids: Iterable[int], texts: Iterable[str], boxes: list[Box], least: float = 0.70) -> int:
    """Tokens of which a later one has the same text at nearly the same place. Only
    tokens of one text are compared."""
    alike: dict[str, list[tuple[int, Box]]] = {}
    for bid, text, box in zip(bids, texts, boxes, strict=True):
        alike.setdefault(WHITE.sub(" ", text.casefold().strip(" ")), []).append((bid, box))
    found = set()
    for group in alike.values():
        group.sort()
        for i, (bid, a) in enumerate(group[:-1]):
            if bid not in found and any(bid < other and iou(a, b) >= least for other, b in group[i + 1 :]):
                found.add(bid)
    return len(found)


@F.pandas_udf(LongType())
def repeated(bid: pd.Series, text: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    rows = zip(bid, text, x0, y0, x1, y1, strict=True)
    return pd.Series([repeats_of_page(n.tolist(), t, [Box(*b) for b in zip(*map(list, sides), strict=True)]) for n, t, *sides in rows], dtype="int64")


@query(
    "p19_statuses",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 13 = 0 AS failed, CASE o_orderkey % 5 WHEN 0 THEN 'recovered' WHEN 1 THEN 'degraded' WHEN 2 THEN 'failed' ELSE 'none' END AS outcome, o_orderkey % 7 = 0 AS part, o_custkey % 2 = 0 AS content, o_custkey % 3 AS added FROM orders)
    SELECT o_orderkey, CASE WHEN failed OR outcome = 'failed' THEN 'invalid' WHEN part THEN 'degraded' WHEN outcome = 'recovered' AND content THEN 'ok' WHEN outcome = 'degraded' THEN 'degraded' WHEN NOT content AND added = 0 THEN 'empty' ELSE 'ok' END AS content,
      CASE WHEN failed OR outcome = 'failed' THEN 'failed' WHEN part THEN 'degraded' WHEN outcome = 'recovered' AND content THEN 'recovered' WHEN outcome = 'degraded' THEN 'degraded' WHEN NOT content AND added = 0 THEN 'unknown' ELSE 'clean' END AS stability FROM o""",
)
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(k % 5 == 0, "recovered").when(k % 5 == 1, "degraded").when(k % 5 == 2, "failed").otherwise("none")
    s = C.page_status(k % 13 == 0, outcome, k % 7 == 0, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.*")
