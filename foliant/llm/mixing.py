"""Mixing sources to target weights by Pareto order sampling.

Targets. Source s of size S_s (words) and weight w_s gets
min(cap * S_s, L * w_s), with the level L such that all targets add up to the
share of all words asked for: what a capped source can't take is reshared by
weight until none is above its cap.

Copies. A document of length class c (its binary logarithm) is to be copied
mu_c = min(cap, f * (1 + c)) times on average: longer documents have the
greater inclusion odds, and f is set for each source so that its copies add up
to its target. floor(mu_c) copies are certain. Of the rest lambda_c is the
inclusion probability, and a document's rank is its random odds over its
inclusion odds, u / (1 - u) * (1 - lambda) / lambda, with u a keyed hash of
the document; the source takes documents in that order as long as they fit the
words that remain. The fixed size is one of words, so a few closing rounds
offer what still remains to documents that fit it, in the same order.

No source is sorted as a whole: the cut in the order is found on histograms of
the rank (two rounds of 4,096 bins, summed map-side), and only the rows of the
bin that holds the cut are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, materialise

BINS = 4_096


def _targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """s, source_size, weight -> with target; one row per source."""
    everything = W.partitionBy()
    level = W.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("cap", cap * F.col("source_size"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(level), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything))
    )
    # the level if all sources before this one are capped; the first at which
    # this one is not is the level of all
    mine = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone"))
    fits = ranked.withColumn("level", F.when(mine * F.col("weight") <= F.col("cap"), mine))
    order = W.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = fits.withColumn("level", F.first("level", ignorenulls=True).over(order))
    return found.select(
        "s",
        "source_size",
        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _rates(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """s, c, mu: expected copies of a document of class c in source s."""
    importance = F.greatest(F.lit(0), F.col("c")) + 1.0
    back = W.partitionBy("s").orderBy(F.desc("c"))
    before = back.rowsBetween(W.unboundedPreceding, -1)
    joined = (
        classes.join(checked_broadcast(targets.select("s", "target")), "s")
        .withColumn("a", importance)
        .withColumn("mass", F.col("a") * F.col("words"))
        .withColumn("capped", cap * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("rest", F.sum("mass").over(W.partitionBy("s")) - F.coalesce(F.sum("mass").over(before), F.lit(0.0)))
    )
    mine = F.try_divide(F.greatest(F.col("target") - F.col("capped"), F.lit(0.0)), "rest")
    tried = joined.withColumn("f", F.when(mine * F.col("a") <= cap, mine))
    # classes come from the highest importance down: the first that is not capped sets f
    f = F.first("f", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return tried.withColumn("f", f).select(
        "s", "c", F.least(F.lit(cap), F.coalesce(F.col("f") * F.col("a"), F.lit(cap))).alias("mu")
    )


def _fill(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Take rows (s, k, q, size, ...) of every source in the order of (q, k)
    while their sizes fit ``room`` (s, room): adds ``took`` to all rows.

    The row that no longer fits ends a source's turn."""

    def cut(points: DataFrame, by: list[str], value: Column) -> DataFrame:
        """The bin in which the running sum passes the room, and the sum before it."""
        bins = points.groupBy(*by, value.alias("bin")).agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        run = W.partitionBy(*by).orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(run.rowsBetween(W.unboundedPreceding, 0)))
        return bins.where("upto > room").groupBy(*by).agg(
            F.min("bin").alias("bin"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")
        )

    first = F.floor(F.col("q") * BINS)
    second = F.floor((F.col("q") * BINS - first) * BINS)
    with_room = rows.join(checked_broadcast(left), "s")
    one = materialise(cut(with_room, ["s"], first).withColumnsRenamed({"bin": "b1", "before": "w1"}), "cut1")
    inside = with_room.join(checked_broadcast(one), "s").where(first == F.col("b1"))
    two = cut(inside.withColumn("room", F.col("room") - F.col("w1")), ["s"], second)
    two = materialise(two.withColumnsRenamed({"bin": "b2", "before": "w2"}), "cut2")
    marks = materialise(left.join(one, "s", "left").join(two, "s", "left"), "marks")
    placed = rows.join(checked_broadcast(marks), "s", "left")
    place = (
        F.when(F.col("room").isNull(), F.lit("out"))
        .when(F.col("b1").isNull() | (first < F.col("b1")), F.lit("in"))
        .when(first > F.col("b1"), F.lit("out"))
        .when(F.col("b2").isNull() | (second < F.col("b2")), F.lit("in"))
        .when(second > F.col("b2"), F.lit("out"))
        .otherwise(F.lit("bin"))
    )
    placed = placed.withColumn("place", place)
    order = W.partitionBy("s").orderBy("q", "k", "size").rowsBetween(W.unboundedPreceding, 0)
    ordered = placed.where("place = 'bin'").withColumn(
        "took", F.sum("size").over(order) + F.col("w1") + F.col("w2") <= F.col("room")
    )
    sure = placed.where("place <> 'bin'").withColumn("took", F.col("place") == "in")
    return sure.unionByName(ordered).select(*rows.columns, "took")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    rounds: int = 3,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row with size, source_size, target (of its source) and copies.

    Sources in code-point order (null last, a source like any other) have the
    weights in turn. A null or empty text has size 0 and no copies. Repeated
    rows get equal ranks and so are taken together as long as they fit. An
    empty table stays empty. Input columns of these names are replaced.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    slim = docs.select(
        F.col(id_col).alias("k"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("h"), size.alias("size")
    )
    slim = materialise(slim, "sizes")
    out = allocate(slim, weights, share, cap, seed, rounds)
    return out.withColumnsRenamed({"k": id_col, "source": source})


def allocate(
    slim: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, rounds: int
) -> DataFrame:
    """k, source, h, size -> with source_size, target, copies."""
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    sources = materialise(by_source.withColumn("s", place).withColumn("weight", weight), "sources")
    targets = materialise(_targets(sources, share, cap), "targets")
    named = materialise(sources.select("s", "source").join(targets, "s"), "named")
    rows = slim.join(
        checked_broadcast(named.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    c = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    rows = rows.withColumn("c", c)
    classes = rows.groupBy("s", "c").agg(F.sum("size").alias("words"))
    rates = materialise(_rates(classes, targets, cap), "rates")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k", "h"), 11).cast("double") + 0.5) / float(2**53)
    lam = F.col("mu") - F.col("certain")
    odds = u / (1 - u) * (1 - lam) / lam
    rows = (
        rows.join(checked_broadcast(rates), ["s", "c"])
        .withColumn("certain", F.floor(F.col("mu") + 1e-9))
        .withColumn("q", F.when((lam > 1e-9) & (F.col("size") > 0), odds / (1 + odds)))
        .withColumn("certain", F.when(F.col("size") > 0, F.col("certain")).otherwise(0).cast("long"))
    )
    rows = materialise(rows.withColumn("copies", F.col("certain")).withColumn("open", F.col("q").isNotNull()), "ranked")
    for _ in range(rounds):
        used = rows.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("used"))
        room = materialise(
            targets.join(used, "s").select("s", F.floor(F.col("target") - F.col("used") + 0.5).alias("room")), "room"
        )
        fits = rows.join(checked_broadcast(room), "s").withColumn("fit", F.col("open") & (F.col("size") <= F.col("room")))
        offered = fits.where("fit").drop("fit", "room")
        rest = fits.where("not fit").drop("fit", "room").withColumn("took", F.lit(False))
        filled = _fill(offered, room).unionByName(rest)
        rows = materialise(
            filled.withColumn("copies", F.col("copies") + F.col("took").cast("long"))
            .withColumn("open", F.col("open") & ~F.col("took"))
            .drop("took"),
            "filled",
        )
    return rows.select("k", "source", "h", "size", "source_size", "target", "copies")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )
