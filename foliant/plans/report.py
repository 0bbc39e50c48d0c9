"""The metric suite of a run: page counters, group rates, tables, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report as R
from ..functions import text as T
from .base import table
from .registry import query
from .text import docs


def markdown_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference page of Markdown and its garbled reading for every whole document:
    headings, lists, pipe tables and paragraphs in turn."""
    i = F.col("i")
    lines = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    row = F.concat(F.lit("| "), F.replace("line", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    line = F.when(i % 6 == 0, F.concat(F.lit("\n## "), "line", F.lit("\n"))).when(i % 6 == 1, F.concat(F.lit("- "), "line")).when(i % 6 == 2, F.concat(F.lit("\n"), row)).when(i % 6 == 3, row).otherwise(F.concat(F.lit("\n"), "line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x.line)
    ref = lines.withColumn("line", line).groupBy("doc_id", "source").agg(F.array_join(ordered, "\n").alias("ref"))
    hyp = F.when(F.col("doc_id") % 5 == 0, F.replace("ref", F.lit("## "), F.lit("### "))).when(F.col("doc_id") % 5 == 1, F.replace("ref", F.lit("- "), F.lit(""))).otherwise(F.replace("ref", F.lit("th"), F.lit("d")))
    return ref.withColumn("hyp", F.when(F.col("doc_id") % 17 == 0, "").otherwise(hyp))


@query("a01_a02_page_metrics", None)
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and structure metrics of every page."""
    p = markdown_pairs(spark, sf_dir).select("doc_id", R.text_group("hyp", "ref").alias("t"), R.structure_group("hyp", "ref").alias("s"))
    return p.select("doc_id", *[c.alias(n) for n, c in R.text_rates(F.col("t")).items()], "s.*")


@query("a08_j13_table_metrics", None)
def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and rates of the tables of every page."""
    p = markdown_pairs(spark, sf_dir).select("doc_id", R.table_group("hyp", "ref").alias("c")).select("doc_id", "c.*")
    return p.select("*", *[c.alias(n) for n, c in R.table_rates().items()])


@query("a09_table_rollup", None)
def table_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table metrics of a run per source: sums of page counters, then rates."""
    p = markdown_pairs(spark, sf_dir).select("source", R.table_group("hyp", "ref").alias("c")).select("source", "c.*")
    s = p.groupBy("source").agg(*[F.sum(c).alias(c) for c in R.TABLE_COUNTERS + R.TABLE_SUMS])
    return s.select("*", *[c.alias(n) for n, c in R.table_rates().items()])


@query("a10_page_integrity", None)
def page_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order, repeats, page numbers and validity of every page."""
    return markdown_pairs(spark, sf_dir).select("doc_id", R.integrity_group("hyp", "ref").alias("m")).select("doc_id", "m.*")


LEAK = """t AS (SELECT source, doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 5 < 2 THEN 'ACME Report' || chr(10) || text ELSE text END AS body, text AS ref FROM documents WHERE text IS NOT NULL),
 l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM t),
 e AS (SELECT source, doc_id, ref, len(ls) > 0 AS full_, CASE WHEN len(ls) > 0 THEN substr(ls[1], 1, 60) ELSE '' END AS first, CASE WHEN len(ls) > 0 THEN substr(ls[-1], 1, 60) ELSE '' END AS last FROM l),
 n AS (SELECT source, count(*) AS pages, count(*) FILTER (WHERE full_) AS shown, count(*) FILTER (WHERE trim(ref) <> '') AS with_ref, count(*) FILTER (WHERE trim(ref) <> '' AND NOT full_) AS lost FROM e GROUP BY source),
 f AS (SELECT source, first AS v, count(*) AS c FROM e WHERE first <> '' GROUP BY ALL), g AS (SELECT source, last AS v, count(*) AS c FROM e WHERE last <> '' GROUP BY ALL),
 fh AS (SELECT f.source, sum(c) AS c FROM f JOIN n ON f.source IS NOT DISTINCT FROM n.source WHERE c >= 0.35 * shown GROUP BY ALL),
 gh AS (SELECT g.source, sum(c) AS c FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source WHERE c >= 0.35 * shown GROUP BY ALL)"""


@query(
    "a10_run_leakage",
    f"""WITH {LEAK} SELECT n.source, CASE WHEN pages < 3 OR shown = 0 THEN 0 ELSE round(coalesce(fh.c, 0) / CAST(shown AS DOUBLE), 4) END AS header_leakage_rate,
      CASE WHEN pages < 3 OR shown = 0 THEN 0 ELSE round(coalesce(gh.c, 0) / CAST(shown AS DOUBLE), 4) END AS footer_leakage_rate,
      CASE WHEN with_ref = 0 THEN 0 ELSE round(lost / CAST(with_ref AS DOUBLE), 4) END AS failure_rate
    FROM n LEFT JOIN fh ON fh.source IS NOT DISTINCT FROM n.source LEFT JOIN gh ON gh.source IS NOT DISTINCT FROM n.source""",
)
def run_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that stand on 35% of a run's pages or more, and pages
    of the reference that came out empty. Two fifths of the pages have a header."""
    k = F.col("doc_id")
    d = docs(spark, sf_dir).where("text IS NOT NULL")
    body = F.when(k % 17 == 0, "").when(k % 5 < 2, F.concat(F.lit("ACME Report\n"), "text")).otherwise(F.col("text"))
    p = d.select("source", F.col("text").alias("ref"), body.alias("body")).select("source", "ref", F.length(F.trim(F.regexp_replace("body", r"\s+", " "))).alias("n"), R.edge_lines("body").alias("e"))
    return leakage(p.select("source", "ref", (F.col("n") > 0).alias("shown"), "e.first", "e.last"), ["source"])


def leakage(pages: DataFrame, keys: list[str], share: float = 0.35, least: int = 3) -> DataFrame:
    """keys, header_leakage_rate, footer_leakage_rate, failure_rate of pages with
    ref, shown (has content), first and last. Lines are counted by value first, so a
    header on every page is one row of the join, whatever the number of pages."""
    full = F.trim("ref") != ""
    n = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pages"), F.count_if("shown").alias("_shown"), F.count_if(full).alias("_ref"), F.count_if(full & ~F.col("shown")).alias("_lost"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("first", "last")])).alias("x")
    lines = pages.select(*keys, sides).select(*keys, "x.side", "x.v").where("v <> ''").groupBy(*keys, "side", "v").agg(F.count(F.lit(1)).alias("c"))
    same = F.lit(True)
    right = n
    for key in keys:
        right = right.withColumnRenamed(key, f"_{key}")
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    hot = lines.join(right, same).where(F.col("c") >= share * F.col("_shown"))
    hot = hot.groupBy(*[f"_{key}" for key in keys]).agg(*[F.sum(F.when(F.col("side") == s, F.col("c"))).alias(f"_{s}") for s in ("first", "last")])
    joined = n
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = n.join(hot, on, "left")
    rate = lambda s: F.when((F.col("_pages") < least) | (F.col("_shown") == 0), 0.0).otherwise(F.round(F.coalesce(f"_{s}", F.lit(0)) / F.col("_shown"), 4))
    failure = F.when(F.col("_ref") == 0, 0.0).otherwise(F.round(F.col("_lost") / F.col("_ref"), 4))
    return joined.select(*keys, rate("first").alias("header_leakage_rate"), rate("last").alias("footer_leakage_rate"), failure.alias("failure_rate"))


@query("a36_raw_engine_report", None)
def raw_engine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw run per source: pages read and failed, mean and upper median of the
    strict error rate over whole pages. The median comes from counts per value."""
    from pyspark.sql import Window as W

    p = markdown_pairs(spark, sf_dir).select("source", (F.col("hyp") != "").alias("ok"), R.text_rates(R.text_group("hyp", "ref"))["cer_normalized"].alias("cer"))
    counts = p.where("ok").groupBy("source", "cer").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy("source")
    run = counts.withColumns({"upto": F.sum("k").over(w.orderBy("cer").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("k").over(w)})
    m = run.groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("cer") * F.col("k")) / F.sum("k")).alias("mean_cer"), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("cer"))).alias("median_cer"))
    n = p.groupBy("source").agg(F.count_if("ok").alias("ok_pages"), F.count_if(~F.col("ok")).alias("failed_pages"))
    return n.join(m, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


@query(
    "a35_render_audit",
    """SELECT conv_id, count(*) AS fragments, count(*) FILTER (WHERE NOT (turn % 7 <> 6)) AS lost FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""",
)
def render_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fragment of a conversation must occur in its rendered form, which has
    lost each seventh turn and keeps the place of the others."""
    c = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    mark = F.concat(F.lit("<"), F.col("turn").cast("string"), F.lit("> "), F.col("text"))
    shown = c.where("turn % 7 <> 6").withColumn("m", mark).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "m"))), lambda x: x.m), "\n").alias("md"))
    return audit(c.select("conv_id", mark.alias("fragment")), shown, "conv_id")


def audit(fragments: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """key, fragments, lost: fragments that their document's Markdown lacks, white space aside."""
    flat = lambda c: T.compact(F.col(c))
    j = fragments.join(rendered, key, "left").withColumn("_in", F.coalesce(flat("md").contains(flat("fragment")), F.lit(False)))
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("fragments"), F.count_if(~F.col("_in")).alias("lost"))
