"""op8: fingerprints bit by bit, components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from foliant.llm.simhash import Planes, components, exact_keys, forest, links, near_duplicates, op8_simhash


def fingerprint(text, k=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, radius):
    """id -> smallest id reachable, over all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    want = groups(prints, 2)
    rows = op8_simhash(spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_links_lose_none(spark):
    """Chains at the radius, dense blocks over several tiles: equal to all pairs."""
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(25):
            s ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(s)
    prints = {i: p for i, p in enumerate(sorted(prints))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p), []) for p in prints.values()], "fp long, keys array<long>")
    got = components(links(df, 2, tile=16))
    root = {r.node % 2**64: r.root % 2**64 for r in got.collect()}
    mine = {}
    for i, p in prints.items():
        mine.setdefault(root.get(p, p), set()).add(i)
    theirs = {}
    for i, r in groups(prints, 2).items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_planes_equal_popcounts():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 30))) for _ in range(300)]
    planes = Planes(prints)
    for radius in (0, 1, 2, 3, 7, 14):
        for q in prints[:20]:
            assert planes.within(q, radius) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= radius]
    assert len(forest(prints, None, 64)) == len(prints) - 1


def test_blocks_are_exact():
    rng = random.Random(2)
    for radius in (0, 2, 4):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << i for i in rng.sample(range(64), radius))
            keys = exact_keys(np.array([a, b], dtype=np.uint64), radius)
            assert any(k[0] == k[1] for k in keys)


def test_near_copies(spark):
    """Five-word shingles, similarity of 0.8 and more: copies meet, others do not."""
    rng = random.Random(9)
    vocabulary = [f"term{i}" for i in range(2000)]
    rows, same = [], {}
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(3):
            copy = list(words)
            for _ in range(c):  # one word changes five shingles of 196
                copy[rng.randrange(200)] = "changed"
            rows.append((3 * g + c, " ".join(copy)))
            same[3 * g + c] = 3 * g
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == same


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(by[1]) == 1
    assert {c for i in (3, 4, 6) for _, c in by[i]} == {3}  # no words: fingerprint zero, linked
    assert near_duplicates(no_docs).count() == 0


def test_links_are_verified(spark):
    """Against the exact similarity of all pairs; texts of one template at 0.6 to 0.9."""
    rng = random.Random(3)
    sets, rows = {}, []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(150)]
        for c in range(12):
            words = list(base)
            for at in rng.sample(range(150), c % 6):  # up to five shingles each
                words[at] = f"x{c}y{at}"
            n = 12 * g + c
            rows.append((n, " ".join(words)))
            sets[n] = {tuple(words[i : i + 5]) for i in range(146)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for tile in (8_192, 4):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert len({find(i) for i in sets}) > 12  # some of a template stay apart


def test_recall_at_the_limit(spark):
    """Pairs at a similarity of 0.80 to 0.83 are found, those just under 0.8 are not linked."""
    rng = random.Random(11)
    rows, near, apart = [], set(), set()
    for pair in range(300):
        shingles = (90, 93, 96, 100, 85)[pair % 5]  # two words replaced far apart: ten shingles differ on each side
        words = [f"w{rng.randrange(10**9)}" for _ in range(shingles + 4)]
        other = list(words)
        for at in (20, 50):
            other[at] = f"v{rng.randrange(10**9)}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        (near if (shingles - 10) / (shingles + 10) >= 0.8 else apart).add(pair)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 240 and sum(got[2 * p + 1] == 2 * p for p in near) >= 0.98 * len(near)
    assert all(got[2 * p + 1] == 2 * p + 1 for p in apart)
