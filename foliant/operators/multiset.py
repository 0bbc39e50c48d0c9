"""Multisets as (key, n) rows: intersections by join, rates from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(hyp: DataFrame, ref: DataFrame, keys: list[str], value: str) -> DataFrame:
    """tp, fp, fn per key: the multisets of ``value`` on either side compared.

    Sides are counted before they are joined, so a value met a million times is
    one row of the join."""
    h = hyp.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("nh"))
    r = ref.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("nr"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = h.join(r, [*keys, value], "full")
    return both.groupBy(*keys).agg(
        F.sum(F.least(zero("nh"), zero("nr"))).alias("tp"),
        F.sum(F.greatest(zero("nh") - zero("nr"), F.lit(0))).alias("fp"),
        F.sum(F.greatest(zero("nr") - zero("nh"), F.lit(0))).alias("fn"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> dict[str, Column]:
    """Precision, recall and F1 from counts, 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(ratio(2 * p * r, p + r), digits)}


def match_rates(tp: Column, n_hyp: Column, n_ref: Column, perfect_if_empty: Column, digits: int = 4) -> dict[str, Column]:
    """Precision, recall and the F1 of both as rounded. Without a reference all
    three are 1 where ``perfect_if_empty`` holds; else only what nothing refutes."""
    none = n_ref == 0
    p = F.when(none & perfect_if_empty, 1.0).when(n_hyp > 0, F.round(tp / n_hyp, digits)).when(none, 1.0).otherwise(0.0)
    r = F.when(none, 1.0).otherwise(F.round(tp / n_ref, digits))
    f = F.when(none & perfect_if_empty, 1.0).otherwise(F.round(ratio(2 * p * r, p + r), digits))
    return {"precision": p, "recall": r, "f1": f}


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted values."""
    s = F.sort_array(values)
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)
