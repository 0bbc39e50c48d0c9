"""op6: the SQL twin, hot keys, and files of shards."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq

from foliant.llm.queries import ORACLES
from foliant.llm.sharding import assign_shards, op6_sharding, write_shards


def test_sql(spark, sf, same_rows):
    same_rows(op6_sharding(spark, sf), ORACLES["op6_sharding"])


def test_only_oversized_split(spark):
    docs = spark.createDataFrame([(i % 7, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    rows = assign_shards(docs, limit=2000).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard_id, []).append(r.bytes)
    assert len(rows) == 3000 and all(sum(b) <= 2000 for b in shards.values())
    assert all(r.shard_bytes == sum(shards[r.shard_id]) and r.depth == len(r.shard_id) for r in rows)
    ids = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:], strict=False))  # prefixes are a partition
    for s in ids:  # a parent that fitted would not have been split
        if s:
            assert sum(sum(b) for k, b in shards.items() if k.startswith(s[:-1])) > 2000


def test_equal_rows_part(spark):
    docs = spark.createDataFrame([(1, "same text")] * 2000, "doc_id long, text string")
    rows = assign_shards(docs, limit=500).collect()
    assert len(rows) == 2000 and max(r.shard_bytes for r in rows) <= 500


def test_odd_rows(odd_docs, no_docs):
    assert assign_shards(odd_docs, limit=100).count() == odd_docs.count()
    assert assign_shards(no_docs).count() == 0


def test_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_shards(docs, str(tmp_path / "out"), limit=40_000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and len(glob.glob(str(tmp_path / "out/shard_id=*"))) > 1


def test_files_keep_the_limit(spark, tmp_path):
    """Equal rows, a hot key and an oversized row: bytes per written folder."""
    rows = [(1, "same text")] * 200 + [(2, "x" * (i % 50)) for i in range(50)] + [(2, "y" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_shards(docs, str(tmp_path / "out"), limit=500)
    texts = []
    for folder in glob.glob(str(tmp_path / "out/shard_id=*")):
        part = [t for f in glob.glob(f"{folder}/*.parquet") for t in pq.ParquetFile(f).read(["text"]).column(0).to_pylist()]
        texts += part
        assert sum(map(len, part)) <= 500 or sum(1 for t in part if t) == 1
    assert sorted(texts) == sorted(t for _, t in rows)
