"""Sharding by extendible hashing, in DataFrame functions only.

A shard is a prefix of the rows' hash bits; the directory maps prefixes to
shards. It starts with one shard for all rows; only a shard above the byte
limit is split on one more bit, until every shard fits or is a single row.

The bits of a row are those of its key's hash, then those of its content's
hash, then those of its place in the stored table, 56 of each: rows of one key
part on later bits, equal rows too, so a hot key or a large group of copies
splits like any other shard. Splits are decided on sums of bytes per prefix,
eight bits at a time; rows are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, shuffled

STEP = 8
BITS = 56  # of each of the three hashes: seven steps
LIMIT = 1 << 20


def _bits(level: int) -> Column:
    """The eight bits of a row that step ``level`` looks at, as a number."""
    which, at = divmod(level, BITS // STEP)
    return F.shiftrightunsigned(F.col(f"_h{which}"), BITS - STEP * (at + 1)).bitwiseAND(F.lit(255)).cast("int")


def key_hash(key: Column) -> Column:
    """56 bits of the MD5 of a key's text form, so that other engines get the same."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 14), 16, 10).cast("long")


def assign_shards(
    docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """key, bytes, shard_id (the bits of the prefix, '' for the only shard),
    depth and shard_bytes of every row.

    bytes is the UTF-8 length of the text, 0 for a null one. A null key hashes
    like an empty one. A row above the limit ends alone or with rows of 0 bytes.
    An empty table has no shards. Extra columns are ignored, but ``row``, if
    given, is handed through.
    """
    own = ["_row"] if row else []
    slim = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"),
        key_hash(F.col(key)).alias("_h0"),
        F.xxhash64(F.col(key), F.col(text)).bitwiseAND(F.lit((1 << BITS) - 1)).alias("_h1"),
        *([F.col(row).alias("_row")] if row else []),
    )
    slim = materialise(slim, "sized")
    # numbered once it is stored: the place of a stored row no longer changes
    place = F.xxhash64(F.col("_key"), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << BITS) - 1))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    done: list[DataFrame] = []
    active = slim.withColumn("_h2", place).withColumn("shard_id", F.lit(""))
    if total <= limit:
        done.append(active.select("_key", "bytes", "shard_id", F.lit(int(total)).cast("long").alias("shard_bytes"), *own))
        active = None
    else:
        active = materialise(active, "placed")
    level = 0
    while active is not None:
        at = _bits(level)
        sums = active.groupBy("shard_id", at.alias("_at")).agg(
            F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 0).alias("n")
        )
        # every prefix of these eight bits, with what lies below it
        spread = sums.select(
            "shard_id", "_at", "bytes", "n", F.explode(F.sequence(F.lit(1), F.lit(STEP))).alias("_d")
        ).withColumn("_prefix", F.expr(f"shiftright(_at, {STEP} - _d)"))
        tree = spread.groupBy("shard_id", "_d", "_prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        # the first prefix on a value's path that fits is its shard
        down = tree.select(
            "shard_id",
            "_d",
            "_prefix",
            "bytes",
            ((F.col("bytes") <= limit) | (F.col("n") <= 1)).alias("fits"),
        )
        paths = sums.select("shard_id", "_at", F.explode(F.sequence(F.lit(1), F.lit(STEP))).alias("_d")).withColumn(
            "_prefix", F.expr(f"shiftright(_at, {STEP} - _d)")
        )
        last = level == 3 * (BITS // STEP) - 1
        met = paths.join(down, ["shard_id", "_d", "_prefix"])
        chosen = met.groupBy("shard_id", "_at").agg(
            F.min_by(F.struct("_d", "bytes"), F.when(F.col("fits"), F.col("_d"))).alias("leaf"),
            F.max_by("bytes", "_d").alias("deep_bytes"),
        )
        ends = F.col("leaf").isNotNull() | F.lit(last)
        depth = F.when(F.col("leaf").isNotNull(), F.col("leaf._d")).otherwise(F.lit(STEP))
        bits = F.substring(F.lpad(F.conv(F.col("_at").cast("string"), 10, 2), STEP, "0"), F.lit(1), depth)
        directory = materialise(
            chosen.select(
                "shard_id",
                "_at",
                F.concat("shard_id", bits).alias("_shard"),
                ends.alias("_ends"),
                F.coalesce("leaf.bytes", "deep_bytes").alias("shard_bytes"),
            ),
            "directory",
        )
        placed = (
            active.withColumn("_at", at)
            .join(checked_broadcast(directory), ["shard_id", "_at"])
            .withColumn("shard_id", F.col("_shard"))
        )
        done.append(placed.where("_ends").select("_key", "bytes", "shard_id", "shard_bytes", *own))
        if directory.where("NOT _ends").limit(1).count() == 0:
            break
        active = materialise(placed.where("NOT _ends").select(*active.columns), "oversized")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    carried = [F.col("_row").alias(row)] if row else []
    return out.select(F.col("_key").alias(key), "bytes", "shard_id", F.length("shard_id").alias("depth"), "shard_bytes", *carried)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write every row into the folder of the shard it is assigned to."""
    # numbered in a stored table, so that a number stays with its row
    numbered = materialise(docs.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    shards = materialise(assign_shards(numbered, limit, key, text, "_place").select("_place", "shard_id"), "assigned")
    joined = numbered.join(shuffled(shards), "_place").drop("_place")
    joined.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs)


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 14) AS UBIGINT) AS h
  FROM documents
), b AS (
  SELECT doc_id, bytes, substr(lpad(bin(h), 56, '0'), 1, 40) AS bits FROM d
), p AS (
  SELECT doc_id, bytes, depth, substr(bits, 1, depth) AS prefix
  FROM b, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth)
), s AS (
  SELECT depth, prefix, sum(bytes) AS total, count(*) FILTER (WHERE bytes > 0) AS n FROM p GROUP BY ALL
), f AS (
  SELECT p.doc_id, p.bytes, min(p.depth) AS depth
  FROM p JOIN s USING (depth, prefix) WHERE s.total <= {LIMIT} OR s.n <= 1 GROUP BY ALL
)
SELECT f.doc_id, f.bytes, p.prefix AS shard_id, f.depth, CAST(s.total AS BIGINT) AS shard_bytes
FROM f JOIN p USING (doc_id, depth) JOIN s USING (depth, prefix)
"""
