"""Language ID of words and texts with a linear-chain conditional random field.

Every run of letters is a token, its label a language. Features of a token are
its affixes (1 to 3 letters at either end), its character 2- and 3-grams and its
entry in a lexicon of the training words; transitions between the languages of
neighbouring words are learned with them by maximum conditional likelihood.
Forward-backward gives each word its marginals, so that words of code-switched
text get their own labels; a text's language is the one with the greatest mean
marginal, which is the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = regex.compile(r"\p{L}+")
#: Characters labelled at once.
CHUNK = 1 << 20
BUCKETS = 1 << 16
UNKNOWN = "und"


def tokens(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature buckets of a word; the lexicon's own entries lie above them."""
    out = []
    n = len(word)
    for k in (1, 2, 3):
        if k <= n:
            out += [f"<{word[:k]}", f"{word[-k:]}>"]
    for k in (2, 3):
        out += [word[i : i + k] for i in range(n - k + 1)]
    ids = [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in out]
    if (at := lexicon.get(word)) is not None:
        ids.append(BUCKETS + at)
    return ids


@dataclass
class Crf:
    """Weights of a trained model; small enough to go with a task (see fit)."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (features, labels)
    trans: np.ndarray  # (labels, labels)
    start: np.ndarray
    cache: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> np.ndarray:
        ids = features(word, self.lexicon)
        return self.weights[ids].sum(axis=0) / np.sqrt(len(ids))

    def emissions(self, words: list[str], limit: int = 300_000) -> np.ndarray:
        """exp of the scores of the words, each row's greatest being 1."""
        if len(self.cache) > limit or not hasattr(self, "_table"):
            self.cache.clear()
            self._table = np.empty((1024, len(self.labels)), dtype=np.float64)
        cache = self.cache
        fresh = list(set(words).difference(cache))
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            ids = [features(w, self.lexicon) for w in part]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            e = np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))], np.cumsum(sizes) - sizes)
            e = e / np.sqrt(sizes)[:, None]
            i = len(cache)
            while i + len(part) > len(self._table):
                self._table = np.concatenate([self._table, np.empty_like(self._table)])
            self._table[i : i + len(part)] = np.exp(e - e.max(axis=1, keepdims=True))
            cache.update(zip(part, range(i, i + len(part)), strict=True))
        return self._table[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]], weights: np.ndarray | None = None) -> list[np.ndarray]:
        """Forward-backward over many texts at once; (words, labels) for each.

        With a weight for each text, ``pairs`` gets the weighted sum of the
        marginals of neighbouring labels, which training needs."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        total, L = int(lengths.sum()), len(self.labels)
        if not total:
            return [np.zeros((0, L)) for _ in texts]
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
        base = np.concatenate([[0], np.cumsum(active)])
        # words of step t of all texts lie together
        at = [base[:n] + r for r, n in enumerate(lengths.tolist())]
        em = np.empty((total, L))
        flat = self.emissions([w for i in order for w in texts[i]])
        em[np.concatenate(at)] = flat
        A = np.exp(self.trans - self.trans.max())
        alpha = np.empty((total, L))
        first = em[: active[0]] * np.exp(self.start - self.start.max())
        alpha[: active[0]] = first / first.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            n, b, p = active[t], base[t], base[t - 1]
            x = alpha[p : p + n] @ A
            x *= em[b : b + n]
            x /= x.sum(axis=1, keepdims=True)
            alpha[b : b + n] = x
        beta = np.ones((active[0], L))
        self.pairs = np.zeros((L, L))
        by_row = None if weights is None else weights[order]
        for t in range(longest - 1, -1, -1):
            n, b = active[t], base[t]
            if t + 1 < longest:
                m, c = active[t + 1], base[t + 1]
                z = em[c : c + m] * beta[:m]
                if by_row is not None:
                    both = alpha[b : b + m, :, None] * A * z[:, None, :]
                    both *= (by_row[:m] / both.sum(axis=(1, 2)))[:, None, None]
                    self.pairs += both.sum(axis=0)
                y = z @ A.T
                y /= y.sum(axis=1, keepdims=True)
                beta[:m] = y
            beta[m if t + 1 < longest else 0 : n] = 1.0
            alpha[b : b + n] *= beta[:n]
        alpha /= alpha.sum(axis=1, keepdims=True)
        out: list[np.ndarray] = [np.zeros((0, L))] * len(texts)
        for r, i in enumerate(order):
            out[i] = alpha[at[r]]
        return out

    def predict(self, texts: list[str | None], step: int = 400_000) -> tuple[list[str], list[float]]:
        """Language and score of whole texts; und and 0 where there is no letter."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return labels, scores
        lo = 0
        while lo < len(texts):
            part, size, hi = [], 0, lo
            while hi < len(texts) and size < step:
                part.append(tokens(texts[hi]))
                size += len(part[-1])
                hi += 1
            for i, m in enumerate(self.marginals(part), lo):
                if len(m):
                    mean = m.mean(axis=0)
                    best = int(mean.argmax())
                    labels[i], scores[i] = self.labels[best], float(min(1.0, mean[best]))
            lo = hi
        return labels, scores


def train(samples: list[tuple[list[str], list[int]]], labels: list[str], epochs: int = 4, rate: float = 0.5, lexicon_min: int = 2, l2: float = 1e-4, seed: int = 5) -> Crf:
    """Maximum conditional likelihood by AdaGrad over batches of word windows."""
    L = len(labels)
    counts: dict[str, int] = {}
    for words, _ in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= lexicon_min))}
    rng = np.random.default_rng(seed)
    W, T, S = np.zeros((BUCKETS + len(lexicon), L)), np.zeros((L, L)), np.zeros(L)
    gw, gt, gs = np.full_like(W, 1e-6), np.full_like(T, 1e-6), np.full_like(S, 1e-6)
    known = {w: np.array(features(w, lexicon)) for w in counts}
    model = Crf(labels, lexicon, W, T, S)
    # classes weigh alike, whatever their share of the sample
    share = np.bincount([y for _, ys in samples for y in ys], minlength=L).astype(float)
    factor = np.where(share > 0, share.sum() / np.maximum(share, 1) / L, 0.0)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), 64):
            batch = [samples[i] for i in order[lo : lo + 64]]
            model.cache.clear()
            if hasattr(model, "_table"):
                del model._table
            weight = np.array([factor[ys[0]] for _, ys in batch])
            unary = model.marginals([w for w, _ in batch], weight)
            ids, rows = [], []
            dT, dS = -model.pairs, np.zeros_like(S)
            for (words, ys), m in zip(batch, unary, strict=True):
                d = -m.copy()
                d[np.arange(len(ys)), ys] += 1
                f = factor[ys[0]]
                d *= f
                dS += d[0]
                if len(words) > 1:
                    y = np.array(ys)
                    np.add.at(dT, (y[:-1], y[1:]), f)
                for w, row in zip(words, d, strict=True):
                    k = known[w]
                    ids.append(k)
                    rows.append(np.broadcast_to(row / np.sqrt(len(k)), (len(k), L)))
            ids_, rows_ = np.concatenate(ids), np.concatenate(rows)
            at, inverse = np.unique(ids_, return_inverse=True)
            g = np.zeros((len(at), L))
            np.add.at(g, inverse, rows_)
            g = g / len(batch) - l2 * W[at]
            gw[at] += g * g
            W[at] += rate * g / np.sqrt(gw[at])
            for P, G, d in ((T, gt, dT), (S, gs, dS)):
                d = d / len(batch) - l2 * P
                G += d * d
                P += 0.2 * rate * d / np.sqrt(G)
    model.cache.clear()
    if hasattr(model, "_table"):
        del model._table
    model.weights = model.weights.astype(np.float32)
    return model


def fit(
    labelled: DataFrame,
    per_label: int = 300,
    words_each: int = 80,
    label: str = "lang",
    text: str = "text",
    id_col: str = "doc_id",
    switches: int = 600,
    seed: int = 5,
) -> Crf:
    """Train on at most ``per_label`` texts of each label, ``words_each`` words
    of each from a keyed place: the bound of the driver's memory and of the
    model. The sample is taken by hash, from all rows. ``switches`` windows are
    glued together from pieces of two texts, so that transitions between
    languages are seen in training. The pieces are cut out on the executors; no
    whole text reaches the driver. No rows give a model without labels."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    labels = sorted(counts)
    if not labels:
        return Crf([], {}, np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    u = F.pmod(F.xxhash64(F.lit(seed), id_col, text), F.lit(1 << 30))
    limit = F.lit(0)
    for name in labels:  # hashes below the limit: a third more rows than wanted
        most = min(1 << 30, int((1 << 30) * 1.4 * (per_label + 20) / counts[name]))
        limit = F.when(F.col(label) == name, F.lit(most)).otherwise(limit)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, at in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = tokens(t.as_py())
                at %= max(1, len(words) - words_each + 1)
                kept.append(words[at : at + words_each])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(kept, pa.list_(pa.string()))], names=["y", "u", "words"])

    picked = rows.select(F.col(label).alias("y"), F.col(text).alias("t"), u.alias("u")).where(u < limit)
    picked = picked.mapInArrow(pieces, "y string, u long, words array<string>").where("size(words) > 0").collect()
    samples, taken = [], dict.fromkeys(labels, 0)
    for r in sorted(picked, key=lambda r: (r.y, r.u, r.words)):
        if taken[r.y] < per_label:
            taken[r.y] += 1
            samples.append((r.words, [labels.index(r.y)] * len(r.words)))
    rng = np.random.default_rng(seed)
    for _ in range(min(switches, len(samples)) if len(labels) > 1 else 0):
        a, b = (samples[i] for i in rng.integers(0, len(samples), 2))
        i, j = rng.integers(1, 20, 2)
        x, y = a[0][:i] + b[0][:j], a[1][:i] + b[1][:j]
        samples.append((x, y))
    return train(samples, labels, seed=seed)


def label_words(df: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """All columns with ``words``: array of (word, lang, p), null for a null text;
    und with 0 for every word if the model has no labels."""
    out = df.drop("words")
    cols = out.columns
    place = cols.index(text)
    words_type = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                toks, size, hi = [], 0, lo
                while hi < b.num_rows and size < CHUNK:
                    t = b.column(place)[hi].as_py()
                    toks.append(None if t is None else tokens(t))
                    size += len(t or "")
                    hi += 1
                rows = []
                marginals = model.marginals([ws or [] for ws in toks]) if model.labels else [None] * len(toks)
                for ws, m in zip(toks, marginals, strict=True):
                    if ws is None or m is None:
                        rows.append(ws and [{"word": w, "lang": UNKNOWN, "p": 0.0} for w in ws])
                    else:
                        best = m.argmax(axis=1).tolist() if ws else []
                        rows.append([{"word": w, "lang": model.labels[k], "p": float(m[i, k])} for i, (w, k) in enumerate(zip(ws, best, strict=True))])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, words_type)], names=[*cols, "words"])
                lo = hi

    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())]))
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("words", kind)]))


def identify(df: DataFrame, model: Crf, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns with the language of each whole text and its score in [0, 1];
    und with 0 for a null text, one without a letter, or a model without labels."""
    out = df.drop(pred, score)
    place = out.columns.index(text)
    names = [*out.columns, pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = model.predict(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=names)

    from pyspark.sql import types as T

    return out.mapInArrow(
        run, T.StructType([*out.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
