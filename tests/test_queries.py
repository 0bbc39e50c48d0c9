"""Every query of the reference's operators runs; those with SQL equal it."""

from __future__ import annotations

import pytest

from foliant import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, sf, same_rows, name):
    same_rows(plans.QUERIES[name](spark, sf), plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_reruns_agree(spark, sf, name):
    """Queries beyond SQL: rows, and the same ones each time; their functions have tests of their own."""
    a, b = (sorted(map(repr, plans.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "pages", "cer", "wer", "duplicate_lines"]
    assert set(e.oracle_sql()) <= set(e.queries())
