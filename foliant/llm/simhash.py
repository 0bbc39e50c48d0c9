"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints. A text is cut into words, ASCII letters in lower case, and
   into shingles; each shingle is hashed with XXH64 (seed 42), and a bit of the
   fingerprint is set if more than half of the hashes have it.
2. Blocks. Texts are compared only inside blocks, and only different
   fingerprints are. For a small radius the blocks are exact: the 64 bits fall
   into radius + 3 parts, two fingerprints within the radius agree in at least
   three of them, so a block is a choice of three parts and their bits. For a
   larger radius (similar, not almost equal texts) a block is a pair of
   min-hashes of the text's shingles, in several independent pairs.
3. Comparison. A block stores its fingerprints vertically: plane b is one long
   integer with bit i of every fingerprint. A query's distances to all of them
   are kept as vertical counters, updated by carry-save addition plane by
   plane; once every counter has passed the radius the block is abandoned.
   A block of more than ``tile`` fingerprints is compared in pairs of tiles.
4. Components. A tile leaves a spanning forest of its links; forests are joined
   by large-star and small-star rounds over distributed tables.

For similar texts the radius only proposes: texts are met by their sets of
shingles, a proposed pair of a tile is a link only if the exact Jaccard
similarity of its two sets is high enough, and forests grow from such links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, shuffled

SEED = 42
TILE = 8_192
#: Components of more nodes meet their smallest id apart from the others.
HOT_ROOT = 1_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words if
    they are fewer; none if there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    s, e = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, len(s))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none give zero."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        part = hashes[lo : lo + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


_MIX = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def min_pairs(hashes: np.ndarray, bands: int) -> np.ndarray:
    """For each band, two min-hashes of the shingle set as one number."""
    if not len(hashes):
        return np.zeros(bands, dtype=np.uint64)
    out = np.empty(bands, dtype=np.uint64)
    for b in range(bands):
        pair = []
        for m in _MIX[2 * b : 2 * b + 2]:
            x = hashes * m
            x ^= x >> np.uint64(29)
            pair.append(int((x * _MIX[63]).min()))
        out[b] = xxhash.xxh64_intdigest(f"{b}:{pair[0]}:{pair[1]}", SEED)
    return out


class Planes:
    """Fingerprints of a block stored as bit planes."""

    def __init__(self, prints: list[int]) -> None:
        self.n = len(prints)
        self.all = (1 << self.n) - 1
        bits = np.unpackbits(np.array(prints, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(p.tobytes(), "little") for p in packed]

    def within(self, q: int, radius: int, lo: int = 0) -> list[int]:
        """Positions from ``lo`` on at most ``radius`` bits away from ``q``."""
        width = max(1, (radius + 1).bit_length())
        start = (1 << width) - 1 - radius  # counters overflow beyond the radius
        zero, full = 0, self.all >> lo
        counters = [full if start >> i & 1 else zero for i in range(width)]
        dead = 0
        for b, plane in enumerate(self.planes):
            plane >>= lo
            carry = plane ^ full if q >> b & 1 else plane
            for i in range(width):
                c = counters[i]
                counters[i] = c ^ carry
                carry &= c
                if not carry:
                    break
            if carry:
                dead |= carry
                if dead == full:
                    return []
        alive, out = full & ~dead, []
        while alive:
            low = alive & -alive
            out.append(lo + low.bit_length() - 1)
            alive ^= low
        return out


def forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of a tile, or between two tiles, as a spanning forest."""
    nodes = left if right is None else left + right
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, planes = [], Planes(left if right is None else right)
    shift = 0 if right is None else len(left)
    for i, q in enumerate(left):
        if right is None and i + 1 == len(left):
            break
        for j in planes.within(q, radius, i + 1 if right is None else 0):
            a, b = root(i), root(shift + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((q, nodes[shift + j]))
    return links


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``similarity``?
    Two empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (small + large - common)


def verified_forest(left: list[tuple], right: list[tuple] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between (fingerprint, set's number, set) of a tile, or between two
    tiles: pairs within the radius whose sets are similar, as a spanning forest.
    Only pairs not yet connected by verified links are looked at."""
    nodes = left if right is None else left + right
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = Planes([n[0] for n in (left if right is None else right)])
    shift, out = 0 if right is None else len(left), []
    for i, (fp, number, mine) in enumerate(left):
        if right is None and i + 1 == len(left):
            break
        for j in planes.within(fp, radius, i + 1 if right is None else 0):
            a, b = root(i), root(shift + j)
            if a != b and similar(mine, nodes[shift + j][2], similarity):
                parent[max(a, b)] = min(a, b)
                out.append((number, nodes[shift + j][1]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exact_keys(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Block keys of fingerprints such that any two within the radius share one."""
    parts = radius + 3
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for n, chosen in enumerate(combinations(masks, 3)):
        x = prints & np.uint64(sum(chosen))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        out.append((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return out


def fingerprints(docs: DataFrame, shingle: int, bands: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits) and keys (min-hash pairs, empty if bands is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                fps, keys = [], []
                for t in part.column(1):
                    h = shingle_hashes(t.as_py(), shingle)
                    fps.append(fingerprint(h))
                    keys.append(min_pairs(h, bands).view(np.int64) if bands else np.empty(0, np.int64))
                yield pa.record_batch(
                    [part.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "fp", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, fp long, keys array<long>"
    )


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) between different fingerprints at most ``radius``
    bits apart. ``prints`` has fp and keys; with empty keys blocks are exact."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for key in exact_keys(fp.view(np.uint64), radius):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp)], names=["block", "fp"])

    given = prints.select("fp", F.explode("keys").alias("block")).select("block", "fp").distinct()
    exact = prints.where(F.size("keys") == 0).select("fp").distinct().mapInArrow(keyed, "block long, fp long")
    blocks = materialise(given.unionByName(exact), "blocks")
    large = materialise(
        blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile), "large"
    )
    tiled = blocks.join(large, "block", "left").withColumn(
        "tiles", F.coalesce(F.ceil(F.col("n") / F.lit(tile / 2)), F.lit(1)).cast("int")
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        tiled.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, i, j); a run of them is one task of a tile pair."""
        now, left, right, found = None, [], [], []

        def close() -> None:
            nonlocal left, right
            if now is not None:
                if now[1] == now[2]:
                    if len(left) > 1:
                        found.extend(forest(left, None, radius))
                elif left and right:
                    found.extend(forest(left, right, radius))
            left, right = [], []

        def flush() -> pa.RecordBatch:
            rows = [[signed(x) for x in side] for side in zip(*found, strict=True)] if found else [[], []]
            found.clear()
            return pa.record_batch([pa.array(r, pa.int64()) for r in rows], names=["a", "b"])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for block, i, j, mine, fp in zip(*cols, strict=True):
                if (block, i, j) != now:
                    close()
                    now = (block, i, j)
                (left if mine == i else right).append(fp & (2**64 - 1))
            if len(found) > 50_000:
                yield flush()
        close()
        yield flush()

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, shingle: int, bands: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, the hash th of the text, and of the set of its shingles: its
    number, its own fingerprint and its min-hash pairs (number, set_fp, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                fps, numbers, set_fps, keys = [], [], [], []
                for t in part.column(1):
                    h = shingle_hashes(t.as_py(), shingle)
                    u = np.unique(h)
                    fps.append(fingerprint(h))
                    set_fps.append(fps[-1] if len(u) == len(h) else fingerprint(u))
                    numbers.append(xxhash.xxh64_intdigest(u.astype("<u8").tobytes(), SEED))
                    keys.append(min_pairs(u, bands).view(np.int64))
                long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.record_batch(
                    [part.column(0), part.column(2), long(fps), long(numbers), long(set_fps), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "fp", "number", "set_fp", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "th", F.xxhash64("text")
    ).mapInArrow(run, "doc_id long, th long, fp long, number long, set_fp long, keys array<long>")


def verified_links(
    prints: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: float, tile: int = TILE
) -> DataFrame:
    """Links (a, b) between numbers of sets in a common block whose fingerprints
    are within the radius and whose Jaccard similarity is high enough.
    ``texts`` has th and text; only texts that meet another are read again."""
    sets = prints.groupBy("number").agg(F.min("th").alias("th"), F.min("set_fp").alias("set_fp"), F.first("keys").alias("keys"))
    blocks = materialise(sets.select("number", "th", "set_fp", F.explode("keys").alias("block")), "blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialise(sizes.select("block", F.when(F.col("n") > tile, F.ceil(F.col("n") / F.lit(tile / 2))).otherwise(1).cast("int").alias("tiles")), "sizes")
    met = materialise(blocks.join(shuffled(sizes), "block"), "met")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                found = [np.unique(shingle_hashes(t.as_py(), shingle)).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], names=["th", "hashes"])

    again = materialise(texts.join(shuffled(met.select("th").distinct()), "th", "left_semi").dropDuplicates(["th"]).mapInArrow(cut, "th long, hashes binary"), "sets")
    dealt = (
        met.join(shuffled(again), "th")
        .withColumn("mine", F.pmod(F.xxhash64("number"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("block", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set_fp", "number", "hashes")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right, found = None, [], [], []

        def close() -> None:
            nonlocal left, right
            if now is not None and now[1] == now[2] and len(left) > 1:
                found.extend(verified_forest(left, None, radius, similarity))
            elif left and right:
                found.extend(verified_forest(left, right, radius, similarity))
            left, right = [], []

        def flush() -> pa.RecordBatch:
            sides = list(zip(*found, strict=True)) if found else [[], []]
            found.clear()
            return pa.record_batch([pa.array(x, pa.int64()) for x in sides], names=["a", "b"])

        for b in batches:
            for block, i, j, mine, fp, number, hashes in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                if (block, i, j) != now:
                    close()
                    now = (block, i, j)
                (left if mine == i else right).append((fp & (2**64 - 1), number, np.frombuffer(hashes, dtype="<u8")))
            if len(found) > 50_000:
                yield flush()
        close()
        yield flush()

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the links with the least node of its component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = materialise(e, "edges"), None
    while True:
        # large star: the greater neighbours of a node meet its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        # small star: the smaller neighbours of a node meet the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "small-star")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    radius: int = 24,
    bands: int = 10,
    id_col: str = "doc_id",
    text: str = "text",
    tile: int = TILE,
    similarity: float = 0.8,
) -> DataFrame:
    """doc_id, fp (16 hex digits), component_id, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links. With the defaults
    links are pairs of texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; proposed are pairs within 24 bits in a common
    block of min-hash pairs. With bands=0 links are all pairs of fingerprints
    within the radius. A null text is empty: fingerprint zero, linked like any
    other. Null ids keep null rows; a component of null ids only has a null id.
    Repeated rows get the same component. Extra columns are ignored.
    """
    if bands:
        node = "number"
        prints = materialise(shingle_sets(docs, shingle, bands, id_col, text), "prints")
        texts = docs.select(F.col(text).cast("string").alias("text")).select(F.xxhash64("text").alias("th"), "text")
        comp = components(verified_links(prints, texts, shingle, radius, similarity, tile))
    else:
        node = "fp"
        prints = materialise(fingerprints(docs, shingle, bands, id_col, text), "prints")
        comp = components(links(prints, radius, tile))
    least = materialise(prints.groupBy(node).agg(F.min("doc_id").alias("least")), "least")
    rooted = least.join(comp, least[node] == comp.node, "left").select(
        node, "least", F.coalesce("root", node).alias("root")
    )
    rooted = materialise(rooted, "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    # the few roots with very many nodes would each fill one task of a shuffle
    hot = checked_broadcast(ids.where(F.col("n") > HOT_ROOT).select("root", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot")))
    rooted = rooted.join(hot, "root", "left")
    by_node = rooted.where("_is_hot").select(node, F.col("_hot").alias("component_id")).unionByName(
        rooted.where("_is_hot IS NULL").join(shuffled(ids.where(F.col("n") <= HOT_ROOT)), "root").select(node, "component_id")
    )
    by_node = materialise(by_node, "components")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_node, node).select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, radius=2, bands=0)
