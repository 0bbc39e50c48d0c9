"""op4: the SQL twin, and a brute-force search for repeated runs."""

from __future__ import annotations

from foliant.llm.line_dedup import line_dedup, op4_line_dedup, windows
from foliant.llm.queries import ORACLES


def brute(docs, least):
    """docs: (id, text) in order. Every run of lines of at least ``least`` words that
    occurred before goes, the first one stays."""
    first, out = {}, {}
    for d, text in docs:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for z in range(a, len(lines)):
                total += len(lines[z][1].split())
                if total >= least:
                    key = tuple(x for _, x in lines[a : z + 1])
                    if first.setdefault(key, (d, a)) != (d, a):
                        gone |= {i for i, _ in lines[a : z + 1]}
        out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_sql(spark, sf, same_rows):
    same_rows(op4_line_dedup(spark, sf), ORACLES["op4_line_dedup"])


def test_brute_force(spark):
    import random

    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 12))) for _ in range(12)]
    docs = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for d in range(60)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=15).collect()}
    assert got == brute(docs, 15)


def test_fingerprints_are_minima_of_windows():
    text = "\n".join(f"alpha beta gamma {i}" for i in range(20))
    lines, numbers, spans = windows(text, 10)
    assert all(a <= at <= z for a, z, at in spans) and numbers == list(range(20))
    # a shifted copy of the lines selects the same lines
    again = windows("head\n" + text, 10)
    assert {lines[at] for *_, at in spans} <= {again[0][at] for *_, at in again[2]}


def test_odd_rows(odd_docs, no_docs):
    got = line_dedup(odd_docs)
    assert got.count() == odd_docs.count()
    texts = {}
    for r in got.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[3] == [None] and texts[4] == [""]
    assert len(texts[1]) == 2 and len(set(texts[1])) == 1  # repeated rows stay alike
    assert texts[2] == [""]  # the later document loses both of its copies
    assert line_dedup(no_docs).count() == 0
