"""Line dedup by winnowing over line hashes.

A run is a row of consecutive lines (lines without a word are passed over) that
together have at least ``min_words`` words. A line is deleted if it lies in a
run that occurred before, in a document of a smaller id or higher up in the
same one; the first occurrence stays.

Every run holds a least window: from each line forward, and from each line
backward, the fewest lines that reach ``min_words``. Of each window the line of
the least hash is selected as its fingerprint, so equal runs are guaranteed to
select equal fingerprints, while most lines select nothing of their own.
Positions are joined on fingerprints, and only where a fingerprint occurs again
are its windows looked at: a window that is equal as a whole extends the match
to both sides of the fingerprint, and windows that overlap make up the run.
Their first occurrence is found by a minimum per window, so the many copies of
a popular passage meet one row and are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shield, shuffled

MIN_WORDS = 25
FINGERPRINTS = "doc long, key long, anchor long, windows array<struct<start:int,end:int,hash:string>>"


def windows(text: str, min_words: int) -> tuple[list[str], list[int], list[tuple[int, int, int]]]:
    """Lines with a word, their line numbers, and windows as (start, end, the
    place of the fingerprint), places counting lines with a word."""
    lines, numbers, sizes = [], [], []
    for i, line in enumerate(text.split("\n")):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            lines.append(line)
            numbers.append(i)
            sizes.append(n)
    spans: set[tuple[int, int]] = set()
    end, total = 0, 0
    for start in range(len(lines)):  # forward: the fewest lines from here on
        while end < len(lines) and total < min_words:
            total += sizes[end]
            end += 1
        if total < min_words:
            break
        spans.add((start, end - 1))
        total -= sizes[start]
    start, total = len(lines), 0
    for end in range(len(lines) - 1, -1, -1):  # backward: the fewest up to here
        while start > 0 and total < min_words:
            start -= 1
            total += sizes[start]
        if total < min_words:
            break
        spans.add((start, end))
        total -= sizes[end]
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    return lines, numbers, [(a, b, min(range(a, b + 1), key=lambda i: (hashes[i], i))) for a, b in sorted(spans)]


def fingerprints(docs: DataFrame, min_words: int, id_col: str, text: str) -> DataFrame:
    """One row per selected fingerprint with the windows that selected it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))

        def batch(cols: list[list]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), kind)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "key", "anchor", "windows"])

        cols: list[list] = [[], [], [], []]
        for b in batches:
            for doc, key, t in zip(*(b.column(i) for i in range(3)), strict=True):
                lines, numbers, spans = windows(t.as_py(), min_words)
                by_anchor: dict[int, list] = {}
                for a, z, at in spans:
                    whole = "\n".join(lines[a : z + 1]).encode("utf-8", "surrogatepass")
                    by_anchor.setdefault(at, []).append((numbers[a], numbers[z], xxhash.xxh3_128_hexdigest(whole)))
                for at, found in by_anchor.items():
                    anchor = xxhash.xxh3_64_intdigest(lines[at].encode("utf-8", "surrogatepass")) >> 1
                    row = (doc.as_py(), key.as_py(), anchor, [{"start": s, "end": e, "hash": h} for s, e, h in found])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield batch(cols)
                    cols = [[], [], [], []]
        yield batch(cols)

    rows = docs.where(F.col(text).isNotNull()).select(_doc(id_col), _key(text), F.col(text).cast("string"))
    return rows.mapInArrow(run, FINGERPRINTS)


def _doc(id_col: str) -> Column:
    """Null ids come before all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc")


def _key(text: str) -> Column:
    return F.xxhash64(F.col(text)).alias("key")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, key (hash of the text), spans: the lines (start, end) to delete."""
    prints = materialise(fingerprints(docs, min_words, id_col, text), "fingerprints")
    # rows of equal id and text are one document here
    again = prints.groupBy("anchor").agg(
        F.min(F.struct("doc", "key")).alias("low"),
        F.max(F.struct("doc", "key")).alias("high"),
        F.sum(F.size("windows")).alias("n"),
    )
    again = materialise(again.where("low <> high OR n > 1").select("anchor"), "anchors")
    met = prints.join(again, "anchor", "left_semi").select("doc", "key", F.explode("windows").alias("w"))
    met = materialise(met.select("doc", "key", "w.start", "w.end", "w.hash"), "windows")
    first = met.groupBy("hash").agg(
        F.min(F.struct("doc", "key", "start")).alias("first"), F.max(F.struct("doc", "key", "start")).alias("last")
    )
    first = materialise(first.where("first <> last").select("hash", "first"), "repeats")
    later = met.join(first, "hash").where(F.struct("doc", "key", "start") > F.col("first"))
    return later.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its text after the deletion of later repeated runs, and
    n_lines and n_removed (lines of the text, lines deleted).

    A null text stays null with 0 lines, an empty one is one line. Rows with
    equal id and text are one document: all stay alike. Null ids come first in
    the order of documents, ties of the id are ordered by the text's hash. A
    text whose lines all go becomes empty. Other columns are kept; input
    columns named n_lines or n_removed are replaced."""
    spans = materialise(repeated_spans(docs, min_words, id_col, text), "spans")
    spans = spans.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    shielded, extra = shield(docs, {id_col, text})
    joined = shielded.withColumns({"_d": _doc(id_col), "_k": _key(text)})
    joined = joined.join(shuffled(spans), (F.col("_d") == F.col("_doc")) & (F.col("_k") == F.col("_key")), "left")
    # arrays are built once per row: see the note on projections in quality.signals
    here = lambda value: F.when(F.monotonically_increasing_id() >= 0, value)
    marked = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s.start, s.end))))
    word = lambda i: F.col("_lines")[i].rlike(r"[^\x20\x09-\x0D]")
    hit = F.col("_spans").isNotNull()
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    out = (
        joined.withColumn("_lines", here(F.split(F.col(text), "\n")))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long"))
        .withColumn("_gone", here(F.when(hit, F.filter(marked, word))))
        .withColumn("_stays", here(F.when(hit, stays)))
        .withColumn("n_removed", F.when(hit, F.size("_gone")).otherwise(0).cast("long"))
        .withColumn(
            "_kept",
            F.when(hit, F.array_join(F.transform("_stays", lambda i: F.col("_lines")[i]), "\n")).otherwise(F.col(text)),
        )
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col("_kept").alias(text) if c == text else F.col(extra.get(c, c)).alias(c) for c in names], "n_lines", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), w AS (
  SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l
), p AS (
  SELECT doc_id, line_no, line, n,
         row_number() OVER d AS pos, sum(n) OVER d AS upto
  FROM w WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)
), fw AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e
  FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
), bw AS (
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e
  FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
), spans AS (SELECT doc_id, s, e FROM fw UNION SELECT doc_id, s, e FROM bw
), whole AS (
  SELECT t.doc_id, t.s, t.e, string_agg(p.line, chr(10) ORDER BY p.pos) AS content
  FROM spans t JOIN p ON p.doc_id = t.doc_id AND p.pos BETWEEN t.s AND t.e GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM whole
), gone AS (
  SELECT DISTINCT p.doc_id, p.line_no
  FROM ranked r JOIN p ON p.doc_id = r.doc_id AND p.pos BETWEEN r.s AND r.e WHERE r.k > 1
), kept AS (
  SELECT w.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
         coalesce(string_agg(w.line, chr(10) ORDER BY w.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
  FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.line_no = w.line_no GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
