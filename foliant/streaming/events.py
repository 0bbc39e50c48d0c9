"""Windows over audit events and resource samples. Each takes a batch or a
stream; on a stream the watermark bounds what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "run string, ts timestamp, rss_kib long, swap_kib long, cpu_ticks long"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A stream of resource samples from JSON lines; half-written lines are passed over."""
    return spark.readStream.schema(SAMPLE).option("mode", "DROPMALFORMED").json(path)


def resource_windows(samples: DataFrame, length: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Peaks of memory per run and interval."""
    w = samples.withWatermark("ts", late).groupBy("run", F.window("ts", length).alias("w"))
    return w.agg(F.max("rss_kib").alias("rss_peak"), F.max("swap_kib").alias("swap_peak"), F.count(F.lit(1)).alias("samples")).select(
        "run", F.col("w.start").alias("start"), "rss_peak", "swap_peak", "samples")


def running_peak(samples: DataFrame) -> DataFrame:
    """The peak per run so far; one row of state a run, nulls are no samples."""
    return samples.groupBy("run").agg(F.max("rss_kib").alias("rss_peak"), F.count("rss_kib").alias("samples"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.col("w.start").alias("start"), "n", "peak")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def first_of_each(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without later repeats of the keys within the watermark (a stream only)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
