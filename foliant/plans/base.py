"""Inputs the queries share, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


#: Rows a Python worker is given at once: a whole text or page may be one.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made from line items: an order is a page, a line item a box."""
    key = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINEITEM))
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pg"),
        key.alias("bid"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.col("l_quantity")).alias("x1"),
        (y0 + 10 + F.col("l_linenumber")).alias("y1"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("status"),
        F.col("l_discount").alias("conf"),
    )


BOXES = f"""b AS (
  SELECT l_orderkey AS pg, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINEITEM)}) AS INTEGER) AS bid,
         CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0,
         CAST(l_partkey % 500 AS DOUBLE) + l_quantity AS x1,
         CAST(l_suppkey % 700 AS DOUBLE) + 10 + l_linenumber AS y1,
         l_returnflag AS kind, l_linestatus AS status, l_discount AS conf
  FROM lineitem)"""
#: the common area of boxes l and r in SQL
SHARED = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"
AREA = "greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0)"
