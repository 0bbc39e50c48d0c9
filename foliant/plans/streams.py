"""Event windows and plug-ins over the given tables, as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..streaming import events as E
from ..streaming import pages as P
from .base import table
from .registry import query
from .text import docs


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t03_resource_windows", """SELECT CAST(user_id AS VARCHAR) AS run, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 2) * 2 AS BIGINT) AS start, max(CAST(floor(value * 10) AS BIGINT)) AS rss_peak, count(*) AS samples FROM events GROUP BY ALL""")
def resource_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("run"), "ts", (F.col("value") * 10).cast("long").alias("rss_kib"), F.lit(0).cast("long").alias("swap_kib"))
    return E.resource_windows(s).select("run", F.unix_timestamp("start").alias("start"), "rss_peak", "samples")


@query("t04_running_peak", "SELECT CAST(user_id AS VARCHAR) AS run, max(CAST(floor(value * 10) AS BIGINT)) AS rss_peak, count(value) AS samples FROM events GROUP BY ALL")
def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_peak(stream_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("run"), (F.col("value") * 10).cast("long").alias("rss_kib")))


@query("t_tumbling", "SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(stream_events(spark, sf_dir)).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "t_sliding",
    """WITH e AS (SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 900) * 900 AS BIGINT) AS s, value FROM events), x AS (SELECT s - 900 * unnest([0, 1, 2, 3]) AS start, value FROM e)
    SELECT CAST(start AS BIGINT) AS start, count(*) AS n, max(value) AS peak FROM x GROUP BY start""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(stream_events(spark, sf_dir)).select(F.unix_timestamp("start").alias("start"), "n", "peak")


@query(
    "t_sessions",
    """WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, value FROM events), g AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, value ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(floor(epoch(min(t))) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(stream_events(spark, sf_dir)).select("user_id", F.unix_timestamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "t01_t02_page_counters",
    """WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS t FROM conversations)
    SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE t IS NULL) AS failed, CAST(sum(length(coalesce(t, ''))) AS BIGINT) AS characters FROM p GROUP BY doc_id""",
)
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their placeholders, rolled up: a quarter of the dumps have lost their characters."""
    c = table(spark, sf_dir, "conversations")
    chars = F.when((F.col("turn") % 4 != 3) & F.col("text").isNotNull(), F.array(F.struct(F.col("text").alias("text"))))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), chars.alias("characters"), F.lit(None).cast("string").alias("corrupt"))
    return P.page_counters(P.with_status(pages))


@query(
    "u02_u07_fake_recogniser",
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s\x{1c}-\x{1f}\x{85}]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT doc_id, count(*) AS tokens, CAST(sum(length(w)) * 6 AS DOUBLE) AS width, 'fake' AS name, 'confidence,words' AS capabilities FROM w GROUP BY doc_id""",
)
def fake_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the recogniser for tests over every document, with who made them."""
    pages = docs(spark, sf_dir).select("doc_id", F.lit(0).alias("page_index"), "text")
    t = plugins.get("recogniser", "fake").apply(pages)
    return t.groupBy("doc_id", F.col("provenance.name").alias("name"), F.array_join("provenance.capabilities", ",").alias("capabilities")).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(F.col("x1") - F.col("x0")).alias("width"))


@query(
    "u05_compare_extractors",
    """SELECT * FROM (VALUES ('broken', 'failure', CAST(0 AS BIGINT)), ('whole', 'success', (SELECT count(*) FROM documents WHERE text IS NOT NULL)),
      ('long', CASE WHEN (SELECT bool_and(n_chars > 500) FROM documents WHERE text IS NOT NULL) THEN 'success' ELSE 'partial' END, (SELECT count(*) FROM documents WHERE n_chars > 500 AND text IS NOT NULL))) AS t(adapter, status, documents)""",
)
def compare_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extractors over the same pages: one whole, one that lacks short pages, one that fails."""
    pages = docs(spark, sf_dir).where("text IS NOT NULL")

    def broken(_: DataFrame) -> DataFrame:
        raise RuntimeError("no such engine")

    rows = plugins.compare(pages, {"whole": lambda p: p, "long": lambda p: p.where("n_chars > 500"), "broken": broken}, pages)
    return plugins.comparison_status(rows)
