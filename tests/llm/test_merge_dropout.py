"""op5: the library's own ids without dropout, lossless decoding with it."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from foliant.llm.merge_dropout import Model, decode, encode, op5_merge_dropout

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_no_dropout_is_the_model(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    model = Model(PATH)
    for t in [*texts, "  two  spaces ", "a" * 500, "Ünïcode 中文 😀\ttab\nline", "▁mark"]:
        if "▁" in t:
            assert model.decode(model.encode(t)) == t
        else:
            assert model.encode(t).tolist() == sp.encode(t)


def plain_encode(sp, text: str, row: int, rate: float, seed: int) -> list[int]:
    """Merge-dropout by the definition, over strings and lists, from the library's
    piece table alone: the best candidate, leftmost of equals, is skipped for good
    if its keyed hash is low, else merged."""

    def mix(x: int) -> int:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    usable = {
        sp.id_to_piece(i): (-sp.get_score(i), i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    }
    as_byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    if not text:
        return []
    text = (" " if sp.encode("a", out_type=str)[0].startswith("▁") else "") + text
    out = []
    for place, word in enumerate(re.findall(" *[^ ▁]+| +|▁", text)):
        if word == "▁":
            out += [as_byte[b] for b in word.encode()]
            continue
        key = mix(mix((row * 0xD1342543DE82EF95 + seed * 0xA24BAED4963EE407) % 2**64) + (place + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
        symbols = list(word.replace(" ", "▁"))
        barred = [False] * len(symbols)  # of the pair that begins here
        number = 0
        while True:
            offers = [
                (usable[a + b][0], i)
                for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                if a + b in usable and not barred[i]
            ]
            if not offers:
                break
            _, i = min(offers)
            number += 1
            if mix(key + number * 0xD6E8FEB86659FD93 & 2**64 - 1) >> 32 < int(rate * 2**32):
                barred[i] = True
                continue
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del barred[i + 1]
            barred[i] = False
            if i:
                barred[i - 1] = False
        for s in symbols:
            out += [usable[s][1]] if s in usable else [as_byte[b] for b in s.encode()]
    return out


def test_ids_are_those_of_the_definition(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() if r.text]
    texts = [t[:1500] for t in texts]
    texts += ["", "  two  spaces ", "▁mark ▁▁ x▁y", "a" * 90, "Ünïcode 中文 😀\ttab\nline", "antidisestablishmentarianism " * 5]
    for rate in (0.1, 0.5):
        model = Model(PATH, rate, 7)
        ids, counts = model.encode_many(texts, list(range(len(texts))))
        mine, lo = [], 0
        for n in counts.tolist():
            mine.append(ids[lo : lo + n].tolist())
            lo += n
        assert mine == [plain_encode(sp, t, row, rate, 7) for row, t in enumerate(texts)]


def test_rows_and_heap_merge_alike():
    """Words short enough for the matrix give the same symbols by the heap."""
    model = Model(PATH, 0.3, 7)
    for n, w in enumerate(("internationalisation", "abcabcabcabc", "rhythm", "antidisestablishmentarianism", "a")):
        symbols = model.chars[np.array([ord(c) for c in w])]
        rows, left = model.merge_rows(symbols[None, :].copy(), np.array([n], dtype=np.uint64))
        assert rows[0][: left[0]].tolist() == model.merge_long(symbols, n)


def test_dropout_varies_and_decodes(spark, sf):
    rows = op5_merge_dropout(spark, sf)
    assert rows.where("NOT lossless").count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = encode(docs, PATH, rate=0.0).select("doc_id", F.col("n_tokens").alias("plain"))
    assert rows.join(plain, "doc_id").where("n_tokens > plain").count() > 0.9 * docs.count()
    back = decode(rows, PATH).join(docs.withColumnRenamed("text", "was"), "doc_id")
    assert back.where("text <> was").count() == 0
    again = op5_merge_dropout(spark, sf).select("doc_id", F.col("ids").alias("i2"))
    assert rows.join(again, "doc_id").where("ids <> i2").count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = encode(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count() and all(r.lossless for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [0, 0]
    assert encode(no_docs, PATH).count() == 0


def test_occurrences_have_skips_of_their_own():
    """A hot word in many rows takes more than four forms; each one is the agenda's own."""
    model = Model(PATH, 0.1, 5)
    word = "international"
    forms = {tuple(model.encode(word, row).tolist()) for row in range(2000)}
    assert len(forms) > 8
    within = model.encode(" ".join([word] * 2000), 1)
    assert len(within) > 2000 and model.decode(within) == " ".join([word] * 2000)
