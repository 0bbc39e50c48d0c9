"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are held in blocks. A block keeps, for every dimension, its rows in
the order of that component. A query walks the lists of all dimensions at once,
from the top where its own component is positive and from the bottom where it
is negative; what it meets for the first time is scored in full (random
access). With t_d the component the walk of list d has come to, no row unseen
can score more than sum(q_d * t_d). The walk stops once that bound is below
the k-th best score so far: not even a tie can be missed then.
Depths double, so that a round is one matrix product over its new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


class Lists:
    """The sorted lists of a block of integer vectors (rows are candidates)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)  # ascending by dimension
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.top = int(np.abs(x).max(initial=0))
        self.as_float: dict = {}

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the best k, best first, ties to the smaller id, and
        how many rows were scored. ``floor``: a score k others already reach."""
        n = len(self.ids)
        # sums of products are exact in floats as long as they fit the mantissa
        most = self.top * int(np.abs(q).max(initial=0)) * max(1, len(q))
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        x = self.as_float.setdefault(kind, self.x.astype(kind) if kind not in self.as_float else None)
        y = q.astype(kind)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        seen = np.zeros(n, dtype=bool)
        got_i, got_s = np.empty(0, np.int64), np.empty(0, np.int64)
        depth = min(n, max(8, k))
        done = 0
        while True:
            if len(dims):
                rows = np.arange(done, depth)
                met = np.zeros(n, dtype=bool)
                met[self.order[n - 1 - rows][:, dims[up]]] = True
                met[self.order[rows][:, dims[~up]]] = True
                new = np.flatnonzero(met & ~seen)
            else:
                new, depth = np.arange(n), n
            seen[new] = True
            s = (x[new] @ y).astype(np.int64)
            keep = self.ids[new] != own
            got_i, got_s = np.concatenate([got_i, self.ids[new][keep]]), np.concatenate([got_s, s[keep]])
            if len(got_s) > k:
                best = np.lexsort((got_i, -got_s))[:k]
                got_i, got_s = got_i[best], got_s[best]
            done = depth
            if done >= n:
                break
            at = np.where(up, self.values[n - done, dims], self.values[done - 1, dims])
            bound = int((q[dims] * at).sum())
            low = int(got_s.min()) if len(got_s) == k else None
            low = floor if low is None or (floor is not None and floor > low) else low
            if low is not None and bound < low:
                break
            depth = min(n, 2 * depth)
        best = np.lexsort((got_i, -got_s))[:k]
        return got_i[best], got_s[best], int(seen.sum())


def _vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Floors of scaled components as long; rows with a null or non-finite part are dropped."""
    bad = F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"),
    )


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 64,
    block_rows: int = 16_384,
    query_rows: int = 4_096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    A candidate of the query's own id takes no part. Vectors that are null,
    hold a null or a non-finite component, or have no id take no part; vectors
    of another length than a query's score nothing with it. Repeated rows of
    an id count each. Empty tables give an empty result.

    Queries in blocks meet candidates in blocks, each pair in one task of
    bounded size; per pair k rows a query leave, and the best k of them are
    found by rank.
    """
    spark = queries.sparkSession
    qs = materialise(_vectors(queries, id_col, vec_col, scale).where(F.size("x") >= 0), "queries")
    cs = materialise(_vectors(candidates, id_col, vec_col, scale), "candidates")
    n_c = max(1, -(-cs.count() // block_rows))
    n_q = max(1, -(-qs.count() // query_rows))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n)).cast("int")
    # copies of a block differ only in the number of the block they meet
    left = qs.select(F.lit(0).alias("side"), spread(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), "vec_id", "x")
    right = cs.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), spread(n_c).alias("cb"), "vec_id", "x")
    tiles = left.unionByName(right)

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, ids, vecs = [], [], []
        for b in batches:
            side.append(b.column(0).to_numpy(zero_copy_only=False))
            ids.append(b.column(3).to_numpy(zero_copy_only=False))
            vecs += [np.asarray(v, dtype=np.int64) for v in b.column(4).to_numpy(zero_copy_only=False)]
        side, ids = np.concatenate(side), np.concatenate(ids)
        dims = np.array([len(v) for v in vecs])
        out_q, out_v, out_s = [], [], []
        for d in np.unique(dims):
            mine, his = np.flatnonzero((dims == d) & (side == 0)), np.flatnonzero((dims == d) & (side == 1))
            if not len(mine) or not len(his):
                continue
            his = his[np.argsort(ids[his], kind="stable")]
            lists = Lists(ids[his], np.stack([vecs[i] for i in his]).reshape(len(his), d))
            for i in mine[np.argsort(ids[mine], kind="stable")]:
                v, s, _ = lists.search(vecs[i], int(ids[i]), k)
                out_q.append(np.full(len(v), ids[i]))
                out_v.append(v)
                out_s.append(s)
        if out_q:
            yield pa.record_batch(
                [pa.array(np.concatenate(a).astype(np.int64)) for a in (out_q, out_v, out_s)],
                names=["query_id", "vec_id", "score"],
            )

    found = tiles.groupBy("qb", "cb").applyInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
