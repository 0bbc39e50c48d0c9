"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of what is not white space; the word of every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: The highest number of rows a table may have to be sent to every executor.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a folder of
    our own is set only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or None
    if path is None:
        path = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/foliant/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back. This cuts the
    lineage at files that outlive any executor, and Catalyst then knows the
    table's size when it decides whether a join may broadcast it."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialised table only after counting that it
    has at most ``limit`` rows; beyond that the join shuffles both sides and
    adaptive execution splits its hot keys."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint a sort-merge join with a table that has rows for documents: it grows
    with the corpus, so the plan is the same at every size and never broadcasts
    it; adaptive execution splits hot keys of such a join."""
    return df.hint("merge")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, for a number of partitions;
    0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shield(df: DataFrame, used: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """Give every column but the used ones a name no operator has, so that extra
    columns clash with nothing; with the new name of each."""
    names = {c: f"__extra{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed(names), names
