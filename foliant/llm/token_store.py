"""Token ids in Parquet list columns: written in key order, read selectively.

File format. A folder of Parquet files; file k holds the k-th range of keys in
ascending order and, inside it, rows in ascending order. Columns: the key,
``part`` (k), ``local_start`` (ids of the rows before it in its file),
``n_tokens`` and ``ids`` as list<int>. Ids are delta-packed (v2 data pages, no
dictionary) or dictionary-encoded, row groups and pages have the sizes asked
for, and Parquet's column and offset indexes let a reader that wants some keys
skip the pages of ids it does not need. The columns beside ``ids`` are read
without touching the ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checked_broadcast, input_bytes, materialise, scratch

#: Words an executor's process remembers, and ids of such words.
MEMORY, MEMORY_IDS = 700_000, 6_000_000
#: Words sent to the library as one text.
GROUP = 128
#: Bytes of texts encoded at once, and of the input for each file at most.
CHUNK, FILE_BYTES = 6 << 20, 64 << 20


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids with these numbers one after another, and how long each is."""
    k = lengths[numbers]
    at = np.arange(int(k.sum())) + np.repeat(starts[numbers] - (np.cumsum(k) - k), k)
    return ids[at], k


class Encoder:
    """Ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Byte-level BPE cuts a text into pieces by a fixed pattern and merges inside
    each; the merges of a piece depend on nothing else, and a single space
    between two characters that are not white space always starts a piece. So
    what stands between such spaces is encoded by the tokenizers library once
    and remembered, many at a time: the ids that open with the space tell where
    the next one starts. A text that holds the string of an added token, or
    any text of another kind of tokenizer, is encoded by the library as a whole.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"]["type"] == "BPE"
            and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(" " in a for a in self.added)
        )
        self.opens = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.opens[[i for t, i in self.tok.get_vocab(with_added_tokens=True).items() if t.startswith("Ġ")]] = True
        self.safe = re.compile(r"(?<=\S) (?=\S)").split
        self._forget()

    def _forget(self) -> None:
        #: word -> its number; -1 where white space at its edge joins the space
        self.table: dict[str, int] = {}
        #: marks that follow a word -> their number; number 0 has no ids
        self.marks: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.used = np.empty(1 << 16, np.int32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, starts: np.ndarray) -> range:
        """Keep ids that are cut at starts; the numbers of the parts."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        n = len(self.starts)
        self.starts = np.concatenate([self.starts, starts + self.used])
        self.lengths = np.concatenate([self.lengths, np.diff(np.append(starts, len(ids)))])
        self.used += len(ids)
        return range(n, n + len(starts))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, new ones learned first."""
        numbers = np.fromiter(map(self.table.get, words, repeat(-2)), np.int64, len(words))
        new = np.flatnonzero(numbers == -2).tolist()
        if new:
            fresh = {words[i] for i in new}
            good = [w for w in fresh if w and w == w.strip()]
            if len(good) < len(fresh):
                self.table.update((w, -1) for w in fresh.difference(good))
            groups = [" " + " ".join(good[i : i + GROUP]) for i in range(0, len(good), GROUP)]
            ids = np.concatenate([np.empty(0, np.int32), *self._whole(groups)])
            starts = np.flatnonzero(self.opens[ids])
            self.table.update(zip(good, self._store(ids, starts), strict=True))
            numbers[new] = np.fromiter(map(self.table.__getitem__, (words[i] for i in new)), np.int64, len(new))
        return numbers

    def _marks(self, marks: list[str]) -> np.ndarray:
        """The numbers of runs of ASCII marks."""
        fresh = list(set(marks).difference(self.marks))
        if fresh:
            ids = self._whole(fresh)
            ends = np.cumsum([len(i) for i in ids])
            self.marks.update(zip(fresh, self._store(np.concatenate(ids), np.append(0, ends[:-1])), strict=True))
        return np.fromiter(map(self.marks.__getitem__, marks), np.int64, len(marks))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, how many each has, and which
        can't stand alone. Letters and the ASCII marks after them are looked up
        apart: a piece of letters ends there."""
        if len(self.table) + len(self.marks) > MEMORY or self.used > MEMORY_IDS:
            self._forget()
        parts = pc.extract_regex(words, r"^(?P<letters>\pL+)(?P<marks>[!-/:-@\[-`{-~]+)$")
        hit = parts.is_valid()
        letters = pc.if_else(hit, pc.struct_field(parts, "letters"), words).dictionary_encode()
        letters = self._numbers(letters.dictionary.to_pylist())[letters.indices.to_numpy()]
        marks = pc.if_else(hit, pc.struct_field(parts, "marks"), "").dictionary_encode()
        marks = self._marks(marks.dictionary.to_pylist())[marks.indices.to_numpy()]
        ids, k = gather(self.ids, self.starts, self.lengths, np.stack([np.maximum(letters, 0), marks], axis=1).ravel())
        return ids, k.reshape(-1, 2).sum(axis=1), letters < 0

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        special = np.full(len(texts), not self.plain)
        for a in self.added:
            special |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        at = np.flatnonzero(special).tolist()
        for i, ids in zip(at, self._whole([texts[i].as_py() for i in at]), strict=True):
            out[i] = ids
        at = np.flatnonzero(~special)
        if not len(at):
            return out
        texts = texts.filter(pa.array(~special)) if special.any() else texts
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy() - 1
        parts = lists.flatten()
        first = np.zeros(len(parts), dtype=bool)
        first[np.cumsum(counts + 1) - counts - 1] = True
        heads = parts.filter(pa.array(first)).to_pylist()
        words = parts.filter(pa.array(~first)).dictionary_encode()
        pool, lengths, bad = self._words(words.dictionary)
        index = words.indices.to_numpy()
        text_of = np.repeat(np.arange(len(counts)), counts)
        odd = np.zeros(len(counts), dtype=bool)
        odd[text_of[bad[index]]] = True
        odd |= (counts > 0) & np.array([h[-1:].isspace() for h in heads])
        good = ~odd[text_of]
        ids, k = gather(pool, np.cumsum(lengths) - lengths, lengths, index[good])
        ends = np.cumsum(np.bincount(text_of[good], weights=k, minlength=len(counts)).astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        tails = {}
        for i in np.flatnonzero(odd).tolist():
            heads[i], *kept = self.safe(texts[i].as_py())
            tails[i] = gather(self.ids, self.starts, self.lengths, self._numbers(kept))[0]
        for i, (j, head) in enumerate(zip(at.tolist(), self._whole(heads), strict=True)):
            out[j] = np.concatenate([head, tails[i] if odd[i] else ids[starts[i] : ends[i]]])
        return out


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 0,
    encoding: str = "delta",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 64 << 10,
) -> None:
    """Tokenise every whole text and write the ids in ascending key order.

    Null texts count as empty. Rows of one key come in the order of a hash of
    their texts; null keys come first. A key with many rows, equal or not, is
    dealt to many files, and there are more files than shuffle partitions where
    the table is large. Extra columns are not written. An empty table writes an
    empty folder with the schema.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding {encoding!r}: delta or dictionary")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows) // FILE_BYTES)
    order = ["key", "hash", "row"]
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, enc = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lengths = pc.binary_length(texts).to_numpy()
            lo = 0
            while lo < len(texts):  # bounded output, whatever the input batch is
                size, hi = 0, lo
                while hi < len(texts) and size < CHUNK:
                    size += int(lengths[hi])
                    hi += 1
                arrays = enc(texts.slice(lo, hi - lo))
                counts = np.array([len(a) + len(tail) for a in arrays], dtype=np.int64)
                arrays = [x for a in arrays for x in (a, tail)]
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.record_batch(
                    [
                        keys.slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, dtype=np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(arrays))),
                    ],
                    names=["key", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])
                lo = hi

    out = ranged.mapInArrow(encode, "key long, part int, local_start long, n_tokens long, ids array<int>")
    (
        out.withColumnRenamed("key", key)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read the files back with ``start``, the ids of all rows before a row."""
    rows = spark.read.parquet(path)
    # one row per file: the prefix sums of the files are a small table
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    bases = materialise(
        parts.select(
            "part",
            (F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
        ),
        "bases",
    )
    joined = rows.join(checked_broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("local_start"))
    return joined.drop("_base") if columns is None else joined.select(*columns)


def ids_crc32(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the CRC-32 of the ids as little-endian uint32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy()
            data = memoryview(values.view(np.uint8))
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                names=[key, "start", "n_tokens", "ids_crc32"],
            )

    return rows.select(key, "start", "n_tokens", "ids").mapInArrow(
        digest, f"`{key}` long, start long, n_tokens long, ids_crc32 long"
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(read_tokens(spark, path))
