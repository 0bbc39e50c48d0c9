"""op7: the SQL twin, the records on disk, odd pages."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from foliant.llm.queries import ORACLES
from foliant.llm.warc import assemble, op7_warc, parse, read_archives, unzip, write_archives


def test_sql(spark, sf, same_rows):
    same_rows(op7_warc(spark, sf), ORACLES["op7_warc"])


def test_transactions(spark, tmp_path):
    body = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/ b", body), (1, "http://c", body), (2, None, None), (4, "http://d", "short"), (5, "http://e", "short"), (None, "http://f", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' payload_digest", "1 refers_to", "2 value")
    path = str(tmp_path / "w")
    write_archives(pages, path)
    records = read_archives(spark, path, payloads=True)
    assert records.count() == 3 * len(rows)
    got = {r.metadata.fields["page"]: r for r in assemble(records).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert r.request.capture == r.response.record_id == r.metadata.capture == r.capture
    one, three = got["1"], got["3"]
    assert one.response.type == "response" and bytes(one.response.payload).decode() == body
    assert three.response.type == "revisit" and three.response.refers_to == one.capture
    assert three.response.payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert got["2"].response.payload_bytes == 0 and got["2"].response.target_uri is None
    assert got["4"].response.type == got["5"].response.type == "response"
    assert three.response.target_uri == "http://a/%20b"


def test_missing_parts_are_null(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 150), (1, "u", "x" * 150)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    write_archives(pages, path)
    records = read_archives(spark, path)
    lost = assemble(records.where("type <> 'request'")).collect()
    assert len(lost) == 2 and all(r.request is None and r.response is not None for r in lost)


def test_parser():
    data = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 6\r\n\r\na\r\n\r\nb\r\n\r\n"
    assert [b for _, b in parse(unzip(gzip.compress(data) + gzip.compress(data)))] == [b"a\r\n\r\nb"] * 2
    for bad in (b"nothing", data[:-9]):
        try:
            list(parse(bad))
        except ValueError:
            continue
        raise AssertionError


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    assert assemble(read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_repeated_ids_of_other_pages(spark, tmp_path):
    """Records of one page id pair one to one, whatever order they are read in."""
    pages = spark.createDataFrame([(1, "u", "x" * 150), (1, "v", "y" * 120), (None, "w", "z")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    write_archives(pages, path)
    records = read_archives(spark, path)
    rows = assemble(records).collect()
    assert len(rows) == 3 and all(r.request and r.response and r.metadata for r in rows)
    assert sorted(r.response.payload_bytes for r in rows) == [1, 120, 150]
    bare = records.withColumns({"record_id": F.lit(None).cast("string"), "capture": F.lit(None).cast("string")})
    assert assemble(bare).count() == 9
