"""WARC archives: writing them, reading them back, assembling transactions.

Writing. A capture becomes three records: a request, a response (or a revisit
that refers to the response of an equal payload) and a metadata record; request
and metadata name the response in WARC-Concurrent-To. A record ends with two
line ends, so Spark's text writer with that line separator writes the archives
through any file system it knows, with its own commit of whole files.

Reading. Archives are read as whole files of bounded size and parsed by
Content-Length; nothing is inferred from the payload.

Assembly. Records meet by the id of their capture, the record's own for a
response or revisit and WARC-Concurrent-To for the others, and give one nested
row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, scratch

END = "\r\n"
#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Bytes of records in an archive: large tables get the larger ones.
FILE_BYTES, LARGE_FILE_BYTES = 8 << 20, 64 << 20

RECORD = (
    "record_id string, type string, capture string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _header(*lines: tuple[str, Column]) -> Column:
    """A record's header: null values leave their line out."""
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(END)), F.lit("")) for k, v in lines],
        F.lit(END),
    )


def mark_revisits(pages: DataFrame, id_col: str, payload: str, least: int = LEAST) -> DataFrame:
    """Add payload_digest, payload_bytes and refers_to (null: a response).

    Of equal payloads of at least ``least`` bytes the smallest id is the
    response. Digests that occur once need no partner, so only those that
    repeat go into the join; adaptive execution splits one that is hot."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.withColumns(
        {"payload_digest": F.sha2(text.cast("binary"), 256), "payload_bytes": F.octet_length(text).cast("long")}
    )
    slim = rows.where(F.col("payload_bytes") >= least).select("payload_digest", F.col(id_col).alias("_first"))
    first = slim.groupBy("payload_digest").agg(F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first.where("_n > 1").select("payload_digest", "_first"), "repeats")
    joined = rows.join(first, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(id_col))
    return joined.withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int | None = None,
) -> None:
    """Write three records per row of ``pages`` into gzip-compressed archives.

    A null payload is empty; a null address leaves WARC-Target-URI out, and
    white space and control characters in an address are percent-encoded.
    A null id is written as an empty page field. Extra columns are ignored;
    an empty table writes an empty folder."""
    rows = mark_revisits(pages.select(id_col, url, payload), id_col, payload)
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.col(url).cast("string")
    for c in [*map(chr, range(33)), "\x7f", "<", ">"]:
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own = _uuid(F.lit("response"), key)
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, text))
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    facts = F.concat(F.lit("page: "), key, F.lit(f"{END}payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(END))
    size = lambda c: F.octet_length(c).cast("string")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    response = F.concat(
        _header(
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", own),
            *common,
            ("WARC-Refers-To", F.when(revisit, _uuid(F.lit("response"), F.col("refers_to").cast("string")))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Payload-Digest", digest),
            ("Content-Type", F.lit("application/http;msgtype=response")),
            ("Content-Length", size(block)),
        ),
        block,
    )
    others = [
        F.concat(
            _header(
                ("WARC-Type", F.lit(kind)),
                ("WARC-Record-ID", _uuid(F.lit(kind), key)),
                ("WARC-Concurrent-To", own),
                *common,
                ("Content-Type", F.lit(mime)),
                ("Content-Length", size(body)),
            ),
            body,
        )
        for kind, mime, body in (("request", "application/http;msgtype=request", ask), ("metadata", "application/warc-fields", facts))
    ]
    records = rows.withColumn("value", F.explode(F.array(response, *others)))
    # files of bounded size, whatever one partition holds
    mean = rows.agg(F.avg("payload_bytes"), F.count(F.lit(1))).first()
    total = (mean[0] or 0) * (mean[1] or 0) + 900 * (mean[1] or 0)
    if file_bytes is None:
        file_bytes = LARGE_FILE_BYTES if total > 1000 * LARGE_FILE_BYTES else FILE_BYTES
    n = max(1, int(-(-total // file_bytes)))
    per_file = max(1, int(file_bytes / max(1.0, total / max(1, 3 * (mean[1] or 1)))))
    (
        records.select("value")
        .repartition(n)
        .write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 4 * per_file)
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record.

    Raises ValueError where the bytes are no record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        head: dict[str, str] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        size = int(head["content-length"])
        start = end + 4
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield head, data[start : start + size]
        at = start + size
        while data.startswith(b"\r\n", at):
            at += 2


def unzip(data: bytes) -> bytes:
    """All members of a gzip file, in one pass; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        return f.read()


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record (see RECORD); payload is null unless asked for.

    Digest and length of a response are those of the payload read; a revisit
    has the digest of its header."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for content in b.column(0):
                cols: list[list] = [[] for _ in names]

                def batch(cols: list[list]) -> pa.RecordBatch:
                    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

                for head, block in parse(unzip(content.as_py())):
                    kind = head.get("warc-type", "")
                    own, mate = head.get("warc-record-id"), head.get("warc-concurrent-to")
                    digest, size, payload, fields = None, None, None, []
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    elif kind == "revisit":
                        digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
                    elif head.get("content-type") == "application/warc-fields":
                        for line in block.decode("utf-8", "replace").split(END):
                            k, colon, v = line.partition(":")
                            if colon:
                                fields.append((k.strip(), v.strip()))
                    row = (own, kind, own if kind in ("response", "revisit") else mate, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), digest, size, fields, payload if payloads else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    if len(cols[0]) >= 5_000:
                        yield batch(cols)
                        cols = [[] for _ in names]
                yield batch(cols)

    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, response, metadata.

    Of several records of one kind with equal ids (a page written twice) one
    row each is kept: they are numbered in the order of record id, digest, length
    and address, and equal numbers meet. Records that name no capture stand alone
    under their own id, those without any id each for themselves; a missing record
    is a null struct."""
    parts = [c.split()[0] for c in RECORD.split(", ")]
    kind = F.when(F.col("type").isin("response", "revisit"), "response").otherwise(F.col("type"))
    alone = F.concat(F.lit("no id "), F.monotonically_increasing_id().cast("string"))
    rows = records.withColumns({"_group": F.coalesce("capture", "record_id", alone), "_kind": kind})
    order = W.partitionBy("_group", "_kind").orderBy("record_id", "payload_digest", "payload_bytes", "target_uri")
    # dealt by the capture once, for the numbers and for the groups
    rows = rows.repartition("_group").withColumn("_i", F.row_number().over(order))
    whole = F.struct(*parts)
    pick = [F.first(F.when(F.col("_kind") == k, whole), ignorenulls=True).alias(k) for k in ("request", "response", "metadata")]
    met = rows.groupBy("_group", "_i").agg(F.first(F.coalesce("capture", "record_id"), ignorenulls=True).alias("capture"), *pick)
    return met.where("request IS NOT NULL OR response IS NOT NULL OR metadata IS NOT NULL").select("capture", "request", "response", "metadata")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch(spark, "warc")
    write_archives(pages, path)
    captures = assemble(read_archives(spark, path))
    fact = lambda m: F.element_at(F.col("metadata.fields"), m)
    rows = captures.select(
        fact("page").try_cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", fact("payload-bytes").try_cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("_refers"),
        F.col("capture").alias("_capture"),
    )
    # a revisit names the response's record: its page is found by that record's id
    rows = materialise(rows, "captures")
    asked = rows.select(F.col("_refers").alias("_capture")).where("_capture IS NOT NULL").distinct()
    named = rows.where("record_type = 'response'").join(asked, "_capture", "left_semi")
    named = named.groupBy(F.col("_capture").alias("_refers")).agg(F.min("page_id").alias("refers_to"))
    named = materialise(named, "referred")
    return rows.join(named, "_refers", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM r
"""
