"""Pages as a stream: each new dump is extracted, a page that fails leaves a
placeholder, and progress is reported after every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.evidence import PAGE


def read_dumps(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of page dumps as they arrive in a folder; what can't be decoded
    keeps its text in ``corrupt``."""
    reader = spark.readStream.schema(PAGE + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def with_status(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, status, text: a page that can't be read is a failed
    placeholder, so that later pages still come."""
    text = F.array_join(F.transform("characters", lambda c: c.text), "")
    failed = F.col("corrupt").isNotNull() | F.col("page_index").isNull() | F.col("characters").isNull()
    return pages.select(
        "doc_id", "page_index", F.when(failed, "failure").otherwise("success").alias("status"), F.when(failed, "").otherwise(text).alias("text"))


def page_counters(pages: DataFrame) -> DataFrame:
    """Per document: pages seen, failed, and characters; for batches and, in
    update mode, for streams, where a state of three sums per document is kept."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "failure").alias("failed"), F.sum(F.length("text")).alias("characters"))


def extract(
    pages: DataFrame, path: str, checkpoint: str, progress: Callable[[int, int, int], None] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Write pages with their status; after each batch call ``progress`` with the
    batch's number, its pages and its failures. A batch that is run again after a
    failure replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if progress is not None:
            row = batch.sparkSession.read.parquet(f"{path}/batch={number}").agg(F.count(F.lit(1)), F.count_if(F.col("status") == "failure")).first()
            progress(number, row[0], row[1])

    writer = with_status(pages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
