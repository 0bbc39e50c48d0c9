"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

An agenda holds the candidate merges of neighbouring symbols, best score first,
leftmost first among equals. A candidate taken from it is skipped for good when
its keyed hash, over (seed, row, place of the word, number of the candidate),
falls below the dropout rate; else it merges and its new neighbours enter the
agenda. So every occurrence of a word is cut by skips of its own, and every
rerun agrees. Symbols that are no piece fall back to bytes. With a rate of 0
the result is that of the model.

Merges never cross from a letter to a following word mark, as no piece has a
mark after another character (checked when a model is loaded). So a text is
cut there, and the words of many texts run their agendas in step, as rows of a
matrix: in each step every row takes one candidate. Nothing is remembered from
one batch to the next, so memory is bounded by the batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Longer words have an agenda in a heap, one word at a time.
LONGEST = 64
#: Cells of a matrix of words that run in step.
CELLS = 1 << 18
#: Characters encoded at once; a longer text is a batch of its own.
BATCH = 1 << 20
#: Symbols from here on are characters that no piece has, by code point.
OTHER = 1 << 21
NEVER = np.int32((1 << 31) - 1)
SPACE, WORD_MARK = ord(" "), ord(MARK)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """(left symbol, right symbol) -> the symbol they merge to, or -1: a table
    with open addressing, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left)).bit_length() + 3)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.full(1 << self.bits, -1, dtype=np.int32)
        key = left.astype(np.int64) << 32 | right
        at = self._home(key)
        while len(key):
            free = self.keys[at] == -1
            first = np.zeros(len(key), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.merged[at[put]] = key[put], merged[put]
            key, at, merged = key[~put], at[~put], merged[~put]
            at = np.where(self.keys[at] == key, at, at + 1) & (1 << self.bits) - 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right).ravel()
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.merged[at], np.int32(-1))
        again = np.flatnonzero((found != key) & (found != -1))
        while len(again):
            at[again] = at[again] + 1 & (1 << self.bits) - 1
            found = self.keys[at[again]]
            hit = found == key[again]
            out[again[hit]] = self.merged[at[again[hit]]]
            again = again[~hit & (found != -1)]
        return out.reshape(shape)


class Model:
    """A symbol is the number of a piece, that of a character which only occurs
    inside pieces, or OTHER + code point."""

    def __init__(self, path: str, rate: float = 0.0, seed: int = 0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rate, self.seed = rate, seed
        n = sp.get_piece_size()
        scores: dict[str, float] = {}
        number: dict[str, int] = {}
        self.bytes_ = np.zeros(256, dtype=np.int32)
        self.out: list[bytes] = []
        met = 0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[1:-1], 16)] = i
                self.out.append(bytes([int(piece[1:-1], 16)]))
                met += 1
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                number[piece] = i
                scores[piece] = sp.get_score(i)
                self.out.append(piece.replace(MARK, " ").encode())
        if met != 256:
            raise ValueError("the model has no byte fallback, so it can't decode every text")
        if sp.encode(" ﬁ  x ", out_type=str) and sp.decode(sp.encode(" ﬁ  x ")) != " ﬁ  x ":
            raise ValueError("the model normalises its input, so it can't decode every text")
        self.prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        self.crossing = any(MARK in p.lstrip(MARK) for p in number)
        inner = sorted({c for p in number for c in p} - number.keys())
        symbol = number | {c: n + i for i, c in enumerate(inner)}
        self.chars = np.arange(OTHER, OTHER + 0x110000, dtype=np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        places = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # the last place, met by symbol -1, is that of no merge
        self.rank = np.full(n + len(inner) + 1, NEVER, dtype=np.int32)
        pairs = []
        for p, i in number.items():
            self.rank[i] = places[scores[p]]
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, i))
        self.pairs = Pairs(*np.array(pairs, dtype=np.int32).reshape(-1, 3).T)
        self.inner = dict(zip(range(n, n + len(inner)), map(ord, inner), strict=True))
        self.n = n

    def split(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words start in the texts that start at ``starts``: at a space
        after none, at a mark of the text itself and after it."""
        first = np.zeros(len(points), dtype=bool)
        first[starts] = True
        mark = points == WORD_MARK
        before = np.concatenate([[False], mark[:-1]]) if len(points) else mark
        first |= mark | before
        if not self.crossing:
            space = points == SPACE
            first[1:] |= space[1:] & ~space[:-1]
        return np.flatnonzero(first)

    def _skips(self, keys: np.ndarray, number: int) -> np.ndarray:
        h = mixed(keys + np.uint64((number + 1) * 0xD6E8FEB86659FD93 % 2**64))
        return h >> np.uint64(32) < np.uint64(int(self.rate * 2**32))

    def merge_rows(self, symbols: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of symbols (-1 after the end of each) to their rows
        after the agenda and the numbers of symbols left; ``keys`` key the skips."""
        rows = len(symbols)
        out = symbols.copy()
        left = (symbols >= 0).sum(axis=1)
        if symbols.shape[1] < 2:
            return out, left
        work, merged = symbols, self.pairs(symbols[:, :-1], symbols[:, 1:])
        where, number = np.arange(rows), 0
        while True:
            ranks = self.rank[merged]
            best = ranks.argmin(axis=1)
            at = np.arange(len(work))
            live = ranks[at, best] != NEVER
            if not live.all():
                done = ~live
                out[where[done], : work.shape[1]] = work[done]
                out[where[done], work.shape[1] :] = -1
                where, work, merged, keys, best = where[live], work[live], merged[live], keys[live], best[live]
                at = np.arange(len(work))
                if not len(work):
                    return out, left
                width = int(left[where].max())
                if width < work.shape[1]:
                    work, merged = work[:, :width], merged[:, : width - 1]
            skip = self._skips(keys, number) if self.rate > 0 else np.zeros(len(work), dtype=bool)
            number += 1
            merged[at[skip], best[skip]] = -1
            go = at[~skip]
            if not len(go):
                continue
            b = best[~skip]
            # the pair becomes one symbol; what is right of it moves one place left
            new, old = work[go], merged[go]
            i = np.arange(len(go))
            new[i, b] = old[i, b]
            column = np.arange(new.shape[1] - 1)[None, :]
            new[:, :-1] = np.where(column > b[:, None], new[:, 1:], new[:, :-1])
            new[:, -1] = np.where(b == new.shape[1] - 1, new[:, -1], -1)
            if old.shape[1] > 1:
                column = column[:, :-1]
                old[:, :-1] = np.where(column >= b[:, None], old[:, 1:], old[:, :-1])
            old[:, -1] = -1
            has = np.flatnonzero(b > 0)
            old[has, b[has] - 1] = self.pairs(new[has, b[has] - 1], new[has, b[has]])
            has = np.flatnonzero(b < new.shape[1] - 1)
            old[has, b[has]] = self.pairs(new[has, b[has]], new[has, b[has] + 1])
            work[go], merged[go] = new, old
            left[where[go]] -= 1

    def merge_long(self, symbols: np.ndarray, key: int) -> list[int]:
        """The same for one word, with a heap and linked symbols: n log n."""
        word: list[int] = symbols.tolist()
        n = len(word)
        prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.pairs(symbols[:-1], symbols[1:]).tolist()
        rank = self.rank
        agenda = [(int(rank[m]), i, i + 1, word[i], word[i + 1], m) for i, m in enumerate(first) if m >= 0]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], int] = {}
        skips, number = np.empty(0, dtype=bool), 0

        def offer(i: int) -> None:
            j = following[i]
            if j < n:
                pair = (word[i], word[j])
                if (m := known.get(pair)) is None:
                    m = known[pair] = int(self.pairs(np.array(pair[:1]), np.array(pair[1:]))[0])
                if m >= 0:
                    heapq.heappush(agenda, (int(rank[m]), i, j, *pair, m))

        while agenda:
            _, i, j, a, b, m = heapq.heappop(agenda)
            if word[i] != a or word[j] != b or following[i] != j:
                continue
            if self.rate > 0:
                if number == len(skips):
                    more = np.arange(number + 1, 2 * number + 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    h = mixed(np.uint64(key) + more)
                    skips = np.concatenate([skips, h >> np.uint64(32) < np.uint64(int(self.rate * 2**32))])
                number += 1
                if skips[number - 1]:
                    continue
            word[i], word[j] = m, -1
            following[i] = following[j]
            if following[j] < n:
                prev[following[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [s for s in word if s >= 0]

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids, and counts of symbols to counts of ids: a character
        that is no piece becomes the bytes of its UTF-8."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, counts
        points = [self.inner.get(s, s - OTHER) for s in symbols[odd].tolist()]
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in points]
        size = np.ones(len(symbols), dtype=np.int64)
        size[odd] = [len(c) for c in coded]
        out = np.repeat(symbols, size)
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        lengths = size[odd]
        inside = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(start[odd], lengths) + inside] = self.bytes_[raw]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        return out, total[ends] - total[ends - counts]

    def encode_many(self, texts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each;
        ``rows`` key the skips of their words."""
        lead = " " if self.prefix else ""
        whole = [lead + t if t else "" for t in texts]
        points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        length = np.fromiter(map(len, whole), np.int64, len(whole))
        begins = np.cumsum(length) - length
        starts = self.split(points, begins[length > 0])
        size = np.diff(np.append(starts, len(points)))
        text_of = np.searchsorted(begins, starts, "right") - 1
        # of empty texts that begin at one place the last is found, which is the one with words
        words = np.bincount(text_of, minlength=len(texts)) if len(starts) else np.zeros(len(texts), dtype=np.int64)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
        seed = self.seed * 0xA24BAED4963EE407
        row = np.array([(r * 0xD1342543DE82EF95 + seed) % 2**64 for r in rows], dtype=np.uint64)
        keys = mixed(mixed(row)[text_of] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        own = (size == 1) & (points[starts] == WORD_MARK) if len(starts) else np.zeros(0, dtype=bool)
        symbols = self.chars[points]
        # a space is the mark of the pieces, a mark of the text stays itself as bytes
        symbols[points == SPACE] = self.chars[WORD_MARK]
        symbols[starts[own]] = OTHER + WORD_MARK

        counts = np.ones(len(starts), dtype=np.int64)
        results: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        lo = int(np.searchsorted(size[order], 2))
        results.append((order[:lo], symbols[starts[order[:lo]]]))
        short = int(np.searchsorted(size[order], LONGEST, "right"))
        while lo < short:
            width = int(size[order[lo]])
            width += width // 4
            hi = min(int(np.searchsorted(size[order], width, "right")), lo + max(1, CELLS // width), short)
            part = order[lo:hi]
            width = int(size[part[-1]])
            inside = np.arange(width)[None, :] < size[part][:, None]
            index = np.minimum(starts[part][:, None] + np.arange(width)[None, :], len(points) - 1)
            done, left = self.merge_rows(np.where(inside, symbols[index], np.int32(-1)), keys[part])
            counts[part] = left
            results.append((part, done[done >= 0]))
            lo = hi
        for w in order[short:].tolist():
            done = self.merge_long(symbols[starts[w] : starts[w] + size[w]], int(keys[w]))
            counts[w] = len(done)
            results.append((np.array([w]), np.array(done, dtype=np.int32)))
        target = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        for part, done in results:
            k = counts[part]
            flat[np.repeat(target[part] - (np.cumsum(k) - k), k) + np.arange(len(done))] = done
        per_text = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64) if len(starts) else words
        return self._ids(flat, per_text)

    def encode(self, text: str, row: int = 0) -> np.ndarray:
        """Ids of a whole text; ``row`` keys the skips of its words."""
        return self.encode_many([text], [row])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text that gave the ids, whatever merges were skipped."""
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode()
        return text[1:] if self.prefix and text else text


@lru_cache(4)
def load(path: str, rate: float, seed: int) -> Model:
    return Model(path, rate, seed)


def encode(
    docs: DataFrame, model: str, rate: float = 0.1, seed: int = 11, id_col: str = "doc_id", text: str = "text", verify: bool = True
) -> DataFrame:
    """doc_id, n_tokens, lossless, ids for every row.

    A null text counts as empty and has no ids; null ids key like 0. Repeated
    rows get equal ids. lossless tells that decoding the ids gave the text
    (always true if not verified). Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model, rate, seed)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, size, hi = [], 0, lo
                while hi < b.num_rows and size < BATCH:
                    texts.append(b.column(1)[hi].as_py() or "")
                    size += len(texts[-1])
                    hi += 1
                rows = [r or 0 for r in b.column(0).slice(lo, hi - lo).to_pylist()]
                ids, counts = m.encode_many(texts, rows)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                same = [
                    not verify or m.decode(ids[s:e]) == t
                    for t, s, e in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                yield pa.record_batch(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(counts),
                        pa.array(same),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "n_tokens", "lossless", "ids"],
                )
                lo = hi

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, lossless boolean, ids array<int>"
    )


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model, 0.0, 0)
        for b in batches:
            texts = [None if not x.is_valid else m.decode(x.values.to_numpy(zero_copy_only=False)) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
