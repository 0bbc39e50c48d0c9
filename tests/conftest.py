"""One session for all tests, and the comparison with SQL twins."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.7g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Assert that a frame and a query have equal columns and rows."""

    def check(df, sql):
        cols = sorted(df.columns)
        mine = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
        assert mine == theirs

    return check
