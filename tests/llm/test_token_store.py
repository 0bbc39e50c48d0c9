"""op9: ids and checksums against the tokenizers library; the files on disk."""

from __future__ import annotations

import array
import glob
import zlib

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from foliant.llm.token_store import op9_token_store, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows, key=lambda r: r[0]):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=key):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_against_the_library(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_token_store(spark, sf).collect())) == want(docs)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    from foliant.llm.token_store import ids_crc32

    docs = odd_docs.where("doc_id IS NOT NULL")
    write_tokens(docs, str(tmp_path / "t"), PATH)
    got = sorted(map(tuple, ids_crc32(read_tokens(spark, str(tmp_path / "t"))).collect()))
    assert got == want([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0], r[1] or ""))
    write_tokens(odd_docs, str(tmp_path / "n"), PATH)
    assert read_tokens(spark, str(tmp_path / "n")).count() == odd_docs.count()
    write_tokens(no_docs, str(tmp_path / "e"), PATH)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_files(spark, sf, tmp_path):
    """Encodings, row groups and page indexes as asked; metadata reads leave the ids alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for encoding, name in (("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")):
        path = str(tmp_path / encoding)
        write_tokens(docs, path, PATH, encoding=encoding, row_group_bytes=64 << 10, page_bytes=4 << 10)
        files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
        groups = [f.metadata.row_group(g) for f in files for g in range(f.metadata.num_row_groups)]
        ids = [g.column(c) for g in groups for c in range(g.num_columns) if "ids" in g.column(c).path_in_schema]
        assert all(name in c.encodings for c in ids if c.num_values)
        assert all(c.has_column_index and c.has_offset_index for g in groups for c in [g.column(0)])
    slim = read_tokens(spark, str(tmp_path / "delta"), ["doc_id", "start", "n_tokens"])
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan
    few = spark.read.parquet(str(tmp_path / "delta")).where("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in few._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_dealt_out(spark, tmp_path):
    """Equal rows of one key, and of no key, don't end in one file."""
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 7, null) AS doc_id", "'one and the same text' AS text")
    write_tokens(rows.repartition(4), str(tmp_path / "hot"), PATH)
    read = read_tokens(spark, str(tmp_path / "hot"))
    assert read.groupBy("part").count().agg({"count": "max"}).first()[0] < 2000
    spans = sorted((r.start, r.n_tokens) for r in read.select("start", "n_tokens").collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == 4000
