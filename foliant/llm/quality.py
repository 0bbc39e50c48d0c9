"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares one signal of a document with a cutoff. Cutoffs are not
chosen by hand: for every stratum and signal the labelled holdout is read as
a series of binomial experiments, and the strictest cutoff is taken whose
false-rejection rate among good documents is at most ``alpha / signals`` with
confidence ``1 - delta``:

* the test of a cutoff is exact: with k of n good holdout documents rejected,
  p = P(Bin(n, alpha') <= k), which is the Clopper-Pearson upper bound seen
  from the other side;
* cutoffs of one signal are tested from lenient to strict and the sequence
  ends at the first failure (fixed-sequence testing spends delta once on the
  whole ladder), while Bonferroni divides delta by signals times strata;
* a stratum with too few labels certifies nothing, so nothing in it is
  rejected by a learned rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, shield

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: signal -> ladder of cutoffs, from lenient to strict; a document is
#: rejected by a rule if its signal is above the cutoff.
LADDERS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08],
    "shout_share": [0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08],
}

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *LADDERS]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeat_words(grams: Column) -> Column:
    """Words inside 5-word windows whose hash occurs twice or more.

    The windows are sorted by hash; neighbours of equal hash give the starts,
    and a start covers five words or as many as lie before the next one."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0).cast("long"),
            lambda total, i: total
            + F.when(i + 1 < n, F.least(F.lit(5), starts[i + 1] - starts[i])).otherwise(F.lit(5)),
        )

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, i: ((i > 0) & (s[i - 1].h == x.h)) | ((i + 1 < n) & (s[i + 1].h == x.h))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.i))

    let = lambda value, f: F.transform(F.array(value), f)[0]
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(grams)) == F.size(grams)
    return F.when(none, F.lit(0).cast("long")).otherwise(
        let(pairs, lambda s: let(repeated(s), covered))
    )


def _shifted(array: str, by: int, drop: int) -> tuple[Column, Column]:
    """The array without its last ``drop`` elements, and moved up by ``by``."""
    n = F.greatest(F.size(array) - drop, F.lit(0))
    return F.slice(array, 1, n), F.slice(array, by + 1, n)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the signals of LADDERS to every row.

    A null text counts as empty. Input columns of the same names are replaced.
    """
    # The optimiser copies deterministic columns into filters it pushes down, so
    # that an array read inside a lambda would be built anew for each element;
    # it leaves a projection alone that holds a row's own number.
    here = lambda value: F.when(F.monotonically_increasing_id() >= 0, value)
    pair = lambda a, b: F.xxhash64(a, b)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        docs.withColumn("_words", here(_words(t)))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "_h1": here(F.transform("_words", lambda w: F.xxhash64(w))),
                "_lines": here(lines),
            }
        )
        # hashes of 2, 4 and 5 words in a row
        .withColumn("_h2", here(F.zip_with(*_shifted("_h1", 1, 1), pair)))
        .withColumn("_h4", here(F.zip_with(*_shifted("_h2", 2, 2), pair)))
        .withColumn("_n5", F.greatest(F.size("_h1") - 4, F.lit(0)))
        .withColumn("_grams", here(F.zip_with(F.slice("_h4", F.lit(1), F.col("_n5")), F.slice("_h1", F.lit(5), F.col("_n5")), pair)))
    )

    def chars(these: str) -> Column:
        rest = t
        for c in these:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return (F.length(t) - F.length(rest)).cast("long")

    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return (
        out.withColumns(
            {
                "n_symbols": chars(SYMBOLS),
                "_shouts": chars("!?"),
                "_n_lines": F.size("_lines"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": here(_repeat_words(F.col("_grams"))),
            }
        )
        .withColumns(
            {
                "symbol_share": over("n_symbols", "word_chars"),
                "dup_line_share": over("n_dup_lines", "_n_lines"),
                "repeat_share": over("n_repeat_words", "n_words"),
                "shout_share": over("_shouts", "word_chars"),
                "base_failed": (F.col("n_words") < 10)
                | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            }
        )
        .drop("_words", "_h1", "_h2", "_h4", "_n5", "_grams", "_lines", "_n_lines", "_shouts")
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in log space."""
    ratio = p / (1 - p)
    import math

    log1p, start = math.log(ratio), math.log1p(-p)
    state = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct(F.lit(0.0).alias("total"), (n * F.lit(start)).alias("term")),
        lambda s, i: F.struct(
            (s.total + F.exp(s.term)).alias("total"),
            (s.term + F.log((n - i) / (i + 1.0)) + F.lit(log1p)).alias("term"),
        ),
    )
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), state.total))


def cutoffs(
    scored: DataFrame,
    labels: DataFrame,
    stratum: str,
    alpha: float = 0.02,
    delta: float = 0.05,
    ladders: dict[str, list[float]] = LADDERS,
) -> DataFrame:
    """One row per stratum with a cutoff per signal (null: none certified).

    ``labels`` has doc_id and quality; of several labels of a document the
    lowest counts, and a null one does not count. Documents that fail the
    base rules are no part of the experiment, as the rules never see them.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_good")).where(F.col("_good") == 1)
    held = scored.join(good.select("doc_id"), "doc_id", "left_semi").where(~F.col("base_failed"))
    tests = [(s, c) for s, ladder in ladders.items() for c in ladder]
    counts = held.groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(s) > c).alias(f"k{i}") for i, (s, c) in enumerate(tests)],
    )
    share, strata = alpha / len(ladders), F.count(F.lit(1)).over(W.partitionBy())
    long = counts.withColumn("_m", strata).select(
        "_stratum",
        "n",
        "_m",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("signal"),
                        F.lit(ladders[s].index(c)).alias("step"),
                        F.lit(c).alias("cutoff"),
                        F.col(f"k{i}").alias("k"),
                    )
                    for i, (s, c) in enumerate(tests)
                ]
            )
        ).alias("t"),
    )
    # a cutoff that rejects more than its mean share can't pass: no sum then
    p = F.when(F.col("t.k") > F.col("n") * share, F.lit(1.0)).otherwise(
        binomial_cdf(F.col("t.k"), F.col("n"), share)
    )
    passed = long.withColumn("ok", p <= F.lit(delta) / (F.col("_m") * len(ladders)))
    ladder = W.partitionBy("_stratum", "t.signal").orderBy("t.step")
    kept = passed.withColumn("ok", F.min("ok").over(ladder)).where("ok")
    return kept.groupBy("_stratum").agg(
        *[F.min(F.when(F.col("t.signal") == s, F.col("t.cutoff"))).alias(f"cut_{s}") for s in ladders]
    )


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
    ladders: dict[str, list[float]] = LADDERS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add base counts, signals, base_failed, kept to every row of ``docs``.

    kept is false if base_failed or if any certified rule of the row's
    stratum rejects it. ``keep`` names the input columns that the result needs
    (all, if not given; the stratum and doc_id must be among them). A null
    stratum is a stratum of its own. Repeated rows get equal verdicts; an empty
    table or no labels give no learned rule. Input columns named like the added
    ones are replaced.
    """
    shielded, extra = shield(docs, {"doc_id", "text", stratum})
    names = [c for c in (keep or docs.columns) if c not in (*ADDED, "kept")]
    # one pass over the texts; labels meet its output, not the texts
    scored = materialise(signals(shielded).select(*[extra.get(c, c) for c in names], *ADDED), "signals")
    learned = materialise(cutoffs(scored, labels, stratum, alpha, delta, ladders), "cutoffs")
    keyed = scored.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    rules = learned.withColumn(
        "_s", F.coalesce(F.concat(F.lit("="), F.col("_stratum").cast("string")), F.lit(""))
    ).drop("_stratum")
    rejected = [F.coalesce(F.col(s) > F.col(f"cut_{s}"), F.lit(False)) for s in ladders]
    any_rule = rejected[0]
    for r in rejected[1:]:
        any_rule = any_rule | r
    joined = keyed.join(checked_broadcast(rules), "_s", "left")
    kept = (~F.col("base_failed") & ~any_rule).alias("kept")
    return joined.select(*[F.col(extra.get(c, c)).alias(c) for c in names], *ADDED, kept)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_rules(docs, labels, keep=["doc_id", "lang"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
