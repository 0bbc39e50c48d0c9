"""Every stage on odd tables, and the whole run against the stages' contracts."""

from __future__ import annotations

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def odd_sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_stage_on_odd_tables(spark, odd_docs, no_docs, odd_sf, stage):
    name, f = stage
    for docs in (odd_docs, no_docs):
        got = f(spark, docs, odd_sf)
        rows = got.collect()
        assert len(rows) <= 2 * docs.count()
        if name != P.STAGES[-1][0]:
            assert got.columns == P.COLUMNS


def test_order_and_names():
    assert len(P.STAGES) == 5


def test_whole_run(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = P.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert 0 < kept.count() < len(docs)
    rows = P.run(spark, sf).collect()
    assert rows and all(r.lossless for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_one_of_each_group_stays(spark, sf):
    text = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"other{i}" for i in range(120))
    rows = [(i, text if i % 3 else other, "en", "s", 1) for i in range(1, 40)] + [(99, text.replace("word7 ", "x "), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_copies(spark, docs, sf).collect()) == [1, 3]
