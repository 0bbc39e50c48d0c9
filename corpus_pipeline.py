"""The corpus pipeline: five stages, each written as Parquet and read again.

Counted as part of the subpackage foliant.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialise, scratch, shuffled
from foliant.llm.line_dedup import line_dedup
from foliant.llm.merge_dropout import encode
from foliant.llm.mixing import mix
from foliant.llm.quality import apply_rules
from foliant.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_rules(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out; a document of which nothing
    is left goes, and n_chars follows the text."""
    cut = line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return cut.where(left).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the
    document of the smallest id stays."""
    groups = near_duplicates(docs)
    stays = materialise(groups.where("doc_id = component_id").select("doc_id").distinct(), "stays")
    kept = docs.select(*COLUMNS).join(shuffled(stays), "doc_id", "left_semi")
    return kept.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes."""
    # rows of equal id and text are drawn alike
    taken = mix(docs).groupBy(F.col("doc_id").alias("_id"), "h").agg(F.max("copies").alias("copies"))
    taken = materialise(taken.where("copies > 0"), "taken")
    keyed = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    met = keyed.join(shuffled(taken), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("h")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Merge-dropout token ids of every document, checked by decoding."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", segment),
]

#: XXH64 fingerprints, keyed hashes and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{n + 1}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
