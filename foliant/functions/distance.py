"""Edit distances and sequence similarities that Spark has no function for."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(b: list) -> dict:
    """Symbol -> its places in b as bits."""
    places: dict = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    out = {}
    for w, js in places.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[w] = int.from_bytes(bits, "little")
    return out


def _row(eq: int, vp: int, vn: int, full: int) -> tuple[int, int, int, int, int]:
    """The next row of the edit table as bits (Hyyrö): where the diagonal does
    not grow, where the row above grows or falls, and the row's own steps."""
    d0 = (((eq & vp) + vp) ^ vp) | eq | vn
    hp = vn | (full & ~(d0 | vp))
    hn = vp & d0
    up, down = hp << 1 | 1, hn << 1
    return d0 & full, hp, hn, (down | ~(d0 | up)) & full, up & d0 & full


def levenshtein_seq(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences by bit-parallel rows; memory is linear."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b))
    masks, full, last = _masks(b), (1 << len(b)) - 1, len(b) - 1
    vp, vn, d = full, 0, len(b)
    for w in a:
        _, hp, hn, vp, vn = _row(masks.get(w, 0), vp, vn, full)
        d += (hp >> last & 1) - (hn >> last & 1)
    return d


def edit_ops(a: list, b: list, limit: int | None = None) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions that turn a into b.

    The way back prefers a match, then a substitution, a deletion, an insertion.
    With the hypothesis as a, a deletion is one of its words without a
    counterpart and an insertion is a missing reference word. Rows are kept as
    bits for one stretch at a time and made again from its start."""
    a, b = a[:limit], b[:limit]
    masks, full = _masks(b), (1 << len(b)) - 1
    stretch = max(256, math.isqrt(len(a)))
    starts, vp, vn = [], full, 0
    for i, w in enumerate(a):
        if i % stretch == 0:
            starts.append((vp, vn))
        _, _, _, vp, vn = _row(masks.get(w, 0), vp, vn, full)
    i, j, s, d, ins = len(a), len(b), 0, 0, 0
    while i and j:
        first = (i - 1) // stretch * stretch
        vp, vn = starts[first // stretch]
        rows = []
        for w in a[first:i]:
            d0, hp, _, vp, vn = _row(masks.get(w, 0), vp, vn, full)
            rows.append((d0, hp))
        while i > first and j:
            d0, hp = rows[i - 1 - first]
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            elif not d0 >> (j - 1) & 1:
                i, j, s = i - 1, j - 1, s + 1
            elif hp >> (j - 1) & 1:
                i, d = i - 1, d + 1
            else:
                j, ins = j - 1, ins + 1
    return s, d + i, ins + j


@lru_cache(maxsize=1 << 16)
def _short(a: str, b: str) -> int:
    return levenshtein_seq(a, b)


def _apart(gone: Iterable, come: Iterable) -> int:
    """Edits that the numbers of the symbols alone ask for."""
    a, b = Counter(gone), Counter(come)
    return max((a - b).total(), (b - a).total())


def _lines(a: str, b: str) -> list[tuple[str, str]]:
    """Pairs of unequal lines if there are as many on both sides, else the whole texts."""
    x, y = a.split("\n"), b.split("\n")
    return [(p, q) for p, q in zip(x, y, strict=True) if p != q] if len(x) == len(y) else [(a, b)]


def edits(a: str, b: str) -> int:
    """Levenshtein distance of two texts.

    Edits line by line and word by word are enough, and what the numbers of characters
    ask for is the least. Where the two agree that is the distance, in linear time; else
    the whole texts are compared."""
    if not a or not b or a == b:
        return 0 if a == b else max(len(a), len(b))
    pairs: list[tuple[str, str]] = []
    for x, y in _lines(a, b):
        p, q = x.split(" "), y.split(" ")
        if len(p) == len(q):
            pairs += [(v, w) for v, w in zip(p, q, strict=True) if v != w]
        elif len(x) == len(a):
            return levenshtein_seq(a, b)
        else:
            pairs.append((x, y))
    most = sum(_short(v, w) if len(v) + len(w) < 100 else levenshtein_seq(v, w) for v, w in pairs)
    least = _apart("".join(v for v, _ in pairs), "".join(w for _, w in pairs))
    return most if most == least else levenshtein_seq(a, b)


def word_edits(a: str, b: str) -> tuple[int, int, int]:
    """edit_ops of the words of two texts, in linear time where the bounds of ``edits``
    agree over words and leave one answer: substitutions alone, as a prefix of the
    words then is edited by them too, or the difference in length alone."""
    if a == b:
        return 0, 0, 0
    most, more, gone, come, even = 0, 0, [], [], True
    for x, y in _lines(a, b):
        p, q = x.split(), y.split()
        if len(p) == len(q):
            unlike = [(v, w) for v, w in zip(p, q, strict=True) if v != w]
            most += len(unlike)
            gone += [v for v, _ in unlike]
            come += [w for _, w in unlike]
        elif len(x) == len(a):
            return edit_ops(p, q)
        else:
            even, more = False, more + len(p) - len(q)
            most += levenshtein_seq(p, q)
            gone += p
            come += q
    if most == _apart(gone, come):
        if even:
            return most, 0, 0
        if most == abs(more):
            return 0, max(more, 0), max(-more, 0)
    return edit_ops(a.split(), b.split())


def lcs_length(a: list, b: list, limit: int | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    a, b = a[:limit], b[:limit]
    masks = _masks(a)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of ``SequenceMatcher(None, a, b)``.

    From 200 characters on, its blocks grow out of the longest run of characters that
    are rare in b, the first of equal ones. Such runs are looked up by what they hold
    and where, so no pairs of places are met; texts of long rare runs go to the class."""
    n = len(b)
    rare = [c for c, k in Counter(b).items() if k <= n // 100 + 1] if n >= 200 else []
    runs = [[(m.start(), m[0]) for m in re.finditer(f"[{re.escape(''.join(rare))}]+", t)] if rare else [] for t in (a, b)]
    if n < 200 or sum(len(t) ** 2 for side in runs for _, t in side) > 32 * (len(a) + n):
        return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    places: dict[str, list[int]] = {}
    for at, t in runs[1]:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                places.setdefault(t[i:j], []).append(at + i)
    levels: dict[int, tuple[list[int], list[list[int]]]] = {}
    for at, t in runs[0]:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                if (js := places.get(t[i:j])) is None:
                    break
                starts, where = levels.setdefault(j - i, ([], []))
                starts.append(at + i)
                where.append(js)
    total, todo = 0, [(0, len(a), 0, n, max(levels, default=0))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        i, j, size = alo, blo, 0
        for k in range(most, 0, -1):
            starts, where = levels[k]
            for p in range(bisect_left(starts, alo), bisect_right(starts, ahi - k)):
                q = bisect_left(where[p], blo)
                if q < len(where[p]) and where[p][q] + k <= bhi:
                    i, j, size = starts[p], where[p][q], k
                    break
            if size:
                break
        most, x, y = size, i + size, j + size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while x < ahi and y < bhi and a[x] == b[y]:
            x, y = x + 1, y + 1
        if x > i:
            total += x - i
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, most))
            if x < ahi and y < bhi:
                todo.append((x, ahi, y, bhi, most))
    return total


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, as difflib has it."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.LongType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance over characters of whole texts."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance over words separated by white space."""
    return pd.Series([None if x is None or y is None else sum(word_edits(x, y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField("substitutions", T.LongType()), T.StructField("deletions", T.LongType()), T.StructField("insertions", T.LongType())]))
def word_ops(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [word_edits(h or "", r or "") for h, r in zip(hyp, ref, strict=True)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])


@F.pandas_udf(T.LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("recall", T.DoubleType()), T.StructField("precision", T.DoubleType()), T.StructField("ratio", T.DoubleType())]))
def pairwise(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """Multiset recall and precision of words, and the sequence ratio, 6 decimals."""
    rows = []
    for r, c in zip(ref, cand, strict=True):
        x, y = Counter((r or "").split()), Counter((c or "").split())
        both = sum((x & y).values())
        rows.append((round(both / max(1, x.total()), 6), round(both / max(1, y.total()), 6), round(ratio(r or "", c or ""), 6)))
    return pd.DataFrame(rows, columns=["recall", "precision", "ratio"])


def error_rate(distance: Column, reference_length: Column) -> Column:
    """Distance over length; 0 for an empty reference; may exceed 1."""
    return F.when(reference_length == 0, F.lit(0.0)).otherwise(distance / reference_length)
