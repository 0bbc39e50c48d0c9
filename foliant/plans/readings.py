"""Readings of the synthetic pages by several recognisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import readings as R
from .base import AREA, BOXES, SHARED, boxes
from .evidence import PAGES, coverage, evidence, page_tokens, quality_gate
from .registry import ORACLES, query


@query("j15_fused_candidates")
def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of every page: the given one, one that is shifted, one that errs."""
    t = page_tokens(spark, sf_dir)
    n = F.col("bid")
    made = []
    for i, (name, score) in enumerate((("a", 0.9), ("b", 0.8), ("c", 0.5))):
        text = F.when(n % (7 - i) == 0, F.concat("text", F.lit("x" * i))).otherwise(F.col("text"))
        shift = F.when(n % 5 == i, 40.0).otherwise(0.0)
        made.append(t.select("pg", F.lit(name).alias("candidate"), F.lit(name).alias("family"), F.lit(score).alias("score"), n.alias("token_no"), text.alias("text"), "confidence", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1"))
    return R.fused(made[0].unionByName(made[1]).unionByName(made[2]), ["pg"])


@query("d11_paragraphs")
def paragraph_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    lines = b.select("pg", "bid", (F.col("x0") % 12).alias("x0"), (F.col("bid") * 14.0 + F.col("y0") % 7).alias("y0"), (F.col("x0") % 200 + 60).alias("x1"), (F.col("bid") * 14.0 + F.col("y0") % 7 + 10).alias("y1"), F.lit("some text").alias("text"))
    return R.paragraphs(lines, ["pg"], "bid")


@query(
    "k11_turns",
    f"""WITH {BOXES}, g AS (SELECT pg, count(*) AS n, count(*) FILTER (WHERE y1 - y0 > greatest((x1 - x0) * 1.35, 4)) AS tall, count(*) FILTER (WHERE status = 'F') AS half, bool_or(kind = 'A' AND bid = 1) AS odd FROM b GROUP BY pg)
    SELECT pg, CASE WHEN tall >= 3 AND tall >= 0.15 * n THEN '90,270' WHEN half >= 0.6 * n OR odd THEN '180' ELSE '' END AS turns FROM g""",
)
def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = boxes(spark, sf_dir).withColumn("rotation", F.when(F.col("status") == "F", 180).otherwise(0))
    return R.turns(t, ["pg"], (F.col("kind") == "A") & (F.col("bid") == 1)).withColumn("turns", F.array_join("turns", ","))


@query(
    "k10_best_variants",
    f"""WITH {PAGES}, k AS (SELECT pg, kind AS variant, x1 - x0 >= y1 - y0 AS flat, length(text) AS n, greatest(0, least(1, 0.9973 - conf * CASE WHEN pg % 3 = 0 THEN 6 ELSE 1 END)) AS c FROM e),
    g AS (SELECT pg, variant, round(avg(c) + least(0.08, ln(1 + sum(n)) * 0.012) + avg(CASE WHEN flat THEN 1.0 ELSE 0.0 END) * 0.02 + CASE WHEN max(pg) % 2 = 0 THEN least(0.05, count(*) * 0.005) ELSE 0 END, 9) AS score FROM k GROUP BY pg, variant)
    SELECT pg, variant, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY score DESC, variant) AS r FROM g) WHERE r = 1""",
)
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_tokens(spark, sf_dir).withColumnRenamed("kind", "variant")
    return R.best_variants(t, ["pg"], "variant", F.col("pg") % 2 == 0).withColumn("score", F.round("score", 6))


LINES = """CASE bid % 8 WHEN 0 THEN '• item' WHEN 1 THEN 'Figura 2' WHEN 2 THEN 'RESUMO GERAL' WHEN 3 THEN '1.2 Escopo' WHEN 4 THEN 'corpo do texto.' WHEN 5 THEN 'a) parte' WHEN 6 THEN 'Figurado' ELSE '' END"""


@query(
    "k15_line_roles",
    f"""WITH {PAGES}, l AS (SELECT pg, bid, x0, y0, x1, y1, {LINES} AS t, CAST(row_number() OVER (PARTITION BY pg ORDER BY y0, x0, bid, x1, y1) AS INTEGER) AS n FROM e),
    m AS (SELECT *, lag(x0) OVER o AS px, lag(y1) OVER o AS py, median(y1 - y0) OVER (PARTITION BY pg) AS body FROM l WINDOW o AS (PARTITION BY pg ORDER BY n)),
    d AS (SELECT *, (y1 - y0) / body AS ratio, CASE WHEN px IS NULL THEN y0 WHEN abs(px - x0) <= 66 THEN y0 - py ELSE 0 END AS above, abs((x0 + x1) / 2 - 275) <= 99 AS mid, y0 <= 60 AS top, y1 >= 630 AS bottom, t = 'RESUMO GERAL' AS caps, t = '1.2 Escopo' AS num FROM m),
    r AS (SELECT *, CASE WHEN bid % 8 IN (0, 5) THEN 'list' WHEN bid % 8 = 1 THEN 'caption' WHEN bottom AND ratio < 0.88 THEN 'footnote'
      WHEN length(t) BETWEEN 2 AND 120 AND t NOT LIKE '%.' AND (ratio >= 1.28 OR (above > body * 2.5 AND (mid OR num OR caps))) THEN 'title' WHEN top AND (mid OR caps) THEN 'header' WHEN bottom AND (length(t) < 100 OR ratio < 1) THEN 'footer' ELSE 'text' END AS role FROM d)
    SELECT pg, n, role, CAST(sum(f) OVER (PARTITION BY pg ORDER BY n) AS BIGINT) AS run FROM (SELECT *, CAST(coalesce(lag(role) OVER (PARTITION BY pg ORDER BY n) <> role, TRUE) AS INT) AS f FROM r)""",
)
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("bid") % 8
    t = F.when(k == 0, "• item")
    for i, s in enumerate(("Figura 2", "RESUMO GERAL", "1.2 Escopo", "corpo do texto.", "a) parte", "Figurado"), start=1):
        t = t.when(k == i, s)
    n = F.row_number().over(W.partitionBy("pg").orderBy("y0", "x0", "bid", "x1", "y1"))
    lines = evidence(spark, sf_dir).withColumns({"text": t.otherwise(""), "n": n})
    return R.line_roles(lines, ["pg"], "n", F.lit(550.0), F.lit(750.0)).select("pg", "n", "role", "run")


@query(
    "j04_local_fusion",
    f"""WITH {BOXES}, g AS (SELECT pg, bid, x0, y0, x1 + 60 AS x1, y1 + 40 AS y1, CASE WHEN bid % 3 = 1 THEN 'merge_ocr' ELSE 'ocr_region' END AS decision FROM b WHERE bid % 3 > 0 AND kind <> 'A'),
    o AS (SELECT l.pg, l.bid AS region_no, l.decision, r.bid AS token_no, r.status, r.x0, r.y0, r.x1, r.y1 FROM g l JOIN b r ON l.pg = r.pg AND {SHARED} > 0 AND {SHARED} >= 0.25 * least({AREA.format("l")}, {AREA.format("r")})),
    n AS (SELECT pg, bid AS region_no, CASE WHEN pg % 2 = 0 THEN status ELSE kind END AS text, x0 + 2 AS x0, y0, x1 + 2 AS x1, y1 FROM b),
    e AS (SELECT r.pg, r.region_no, r.decision, r.token_no, bool_or(coalesce(l.text = r.status, FALSE)) AS same, count(l.pg) AS met FROM o r LEFT JOIN n l ON l.pg = r.pg AND l.region_no = r.region_no AND {SHARED} > 0.5 * ({AREA.format("l")}) GROUP BY ALL)
    SELECT pg, region_no, decision, count(*) AS tokens, count(*) FILTER (WHERE same) AS matched, count(*) FILTER (WHERE met > 0 AND NOT same) AS conflicts, CASE decision WHEN 'ocr_region' THEN 'ocr' ELSE 'native_preferred' END AS chosen_source FROM e GROUP BY ALL""",
)
def local_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = boxes(spark, sf_dir), F.col("bid")
    regions = b.where("bid % 3 > 0 AND kind <> 'A'").select("pg", n.alias("region_no"), "x0", "y0", (F.col("x1") + 60).alias("x1"), (F.col("y1") + 40).alias("y1"), F.when(n % 3 == 1, "merge_ocr").otherwise("ocr_region").alias("decision"))
    natives = b.select("pg", n.alias("region_no"), F.when(F.col("pg") % 2 == 0, F.col("status")).otherwise(F.col("kind")).alias("text"), (F.col("x0") + 2).alias("x0"), "y0", (F.col("x1") + 2).alias("x1"), "y1")
    tokens = b.select("pg", n.alias("token_no"), F.col("status").alias("text"), "x0", "y0", "x1", "y1")
    return R.local_fusion(regions, natives, tokens, ["pg"])


@query("a39_candidate_records", f"SELECT pg, q.tokens, round(weighted, 4) AS weighted, quartile, sufficient, round(score, 4) AS score, chars, area_coverage, duplicate_ratio FROM ({ORACLES['p16_p24_quality_gate']}) q JOIN ({ORACLES['a20_coverage']}) c USING (pg)")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and coverage of a reading in one record."""
    q = quality_gate(spark, sf_dir).select("pg", "tokens", F.round("weighted", 4).alias("weighted"), "quartile", "sufficient", F.round("score", 4).alias("score"))
    return q.join(coverage(spark, sf_dir).drop("tokens"), "pg")
