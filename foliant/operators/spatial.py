"""Joins and aggregates over boxes.

Boxes meet within a page and a grid cell: the equi-key is (page, cell), so a
join shuffles on it and never compares boxes that lie far apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out by key for work that is heavy for its bytes: adaptive execution
    would join small partitions, but leaves a given number as it is."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def grid_cells(df: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """One row per grid cell a box touches: gx, gy."""
    at = lambda c: F.floor(F.col(prefix + c) / cell).cast("int")
    return df.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn(
        "gy", F.explode(F.sequence(at("y0"), at("y1")))
    )


def spatial_join(left: DataFrame, right: DataFrame, page: list[str], on: Column, cell: float = 64.0) -> DataFrame:
    """Inner join of boxes of one page that meet and satisfy ``on``.

    Columns must be prefixed l_ and r_ (l_x0 ...), the page columns too. A pair
    is kept only in the first cell both share, so no distinct is needed."""
    a = grid_cells(left, cell, "l_")
    b = grid_cells(right, cell, "r_").withColumnsRenamed({"gx": "hx", "gy": "hy"})
    keys = (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy"))
    for p in page:
        keys = keys & (F.col(f"l_{p}") == F.col(f"r_{p}"))
    first = (F.col("gx") == F.floor(F.greatest("l_x0", "r_x0") / cell)) & (F.col("gy") == F.floor(F.greatest("l_y0", "r_y0") / cell))
    return a.join(b, keys).where(first & G.meets(G.box("l_"), G.box("r_")) & on).drop("gx", "gy", "hx", "hy")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def assign(pairs: DataFrame, line: list[str], coverage: str, area: str, confidence: str, order: str, near: float = 0.05) -> DataFrame:
    """The best region of each line: among those within ``near`` of the best
    coverage the smallest, then the most confident (null as 0), then the first."""
    w = W.partitionBy(*line)
    best = w.orderBy(F.col(area), F.coalesce(F.col(confidence), F.lit(0.0)).desc(), F.col(order))
    close = pairs.withColumn("_best", F.max(coverage).over(w)).where(F.col(coverage) >= F.col("_best") - near)
    return close.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_best", "_rank")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of intervals by key; touching ones merge."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_new", (F.col(start) > F.coalesce(reach, F.col(start) - 1)).cast("int"))
    island = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered(boxes: np.ndarray, block: int = 1 << 20) -> float:
    """Area of the union of boxes (rows of x0, y0, x1, y1): slabs between x edges, and in
    each what a box reaches below those before it. Slabs are met ``block`` places at a time."""
    x0, y0, x1, y1 = boxes[np.argsort(boxes[:, 1], kind="stable")].T
    edges = np.unique(np.concatenate([x0, x1]))
    low, high = edges[:-1, None], edges[1:, None]
    total, step = 0.0, max(1, block // len(x0))
    for i in range(0, len(low), step):
        inside = (x0 < high[i : i + step]) & (x1 > low[i : i + step])
        reach = np.maximum.accumulate(np.where(inside, y1, -np.inf), axis=1)
        seen = np.concatenate([np.full((len(reach), 1), -np.inf), reach[:, :-1]], axis=1)
        new = np.where(inside, np.maximum(0.0, y1 - np.maximum(y0, seen)), 0.0)
        total += float((new.sum(axis=1) * (high - low)[i : i + step, 0]).sum())
    return total


@F.pandas_udf(T.DoubleType())
def area_of(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([covered(np.column_stack(b)) for b in zip(x0, y0, x1, y1, strict=True)], dtype="float64")


def union_area(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact area of the union of the boxes of each key. The boxes of a key travel as
    arrays, so a task holds what it was given and no slabs times boxes."""
    solid = df.where("x1 > x0 AND y1 > y0").dropna(subset=keys)
    boxes = solid.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("_b"))
    return boxes.select(*keys, area_of(*[F.col(f"_b.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("union_area"))


def islands(df: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a row for which ``starts`` holds opens one."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_s", (first | F.coalesce(starts, F.lit(False))).cast("int")).withColumn(
        name, F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_s")


def dense_order(df: DataFrame, keys: list[str], order: list[Column], name: str = "order_index") -> DataFrame:
    """Positions from 0 without gaps."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
