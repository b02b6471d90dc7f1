"""SimHash near-duplicate detection with BK-trees.

A fingerprint has a bit set where over half of the shingle hashes have it. Fingerprints are first reduced to distinct ones.
Two of 64 bits that differ in at most r bits agree on all but r of m blocks, so each enters the shards named by its m-r
agreeing blocks; no pair is lost, and crowded shards are keyed again by finer blocks. A shard's BK-tree keys the children of a
node by their Hamming distance to it, and a search follows only the edges within the radius of its own distance. Trees are built
where their shard's rows are: to broadcast them, the fingerprints of all documents would have to pass through the driver. A shard
still above ``SHARD`` rows is cut into blocks, each a tree of bounded size past which the rows of later blocks stream. Found
neighbours are united in the task and only links to the group's first member leave it, so a dense group gives rows in
proportion to its size. Components are found from those links.

Word-shingle near duplicates at a similarity (``similar_documents``) need a far wider radius than blocks of 64 bits allow, so
there fingerprints have 512 bits, and shards are single shingles: of a set of n, the first n - ceil(s n) + 1 in one order of all
shingles. Two sets of similarity s share one of those, so no pair is lost whatever the size of the table or the group. The order
puts shingles that are common in a sample last, which keeps shards small; any order is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.components import connected_components

from .common import texts, width, written

SEED = 42
STEP = 255 * 256
M64 = (1 << 64) - 1
ONES = np.uint64(0x0101010101010101)
#: Rows of one tree (a larger shard becomes several), and links a task holds before it hands them on.
SHARD, LINKS = 4_000, 50_000
#: About so many texts are sampled for common shingles, those in at least ``OFTEN`` of them; at most ``COMMON`` are sent to the tasks.
SAMPLE, OFTEN, COMMON = 5_000, 3, 50_000
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
WIDE = 64 * (1 + len(MIXERS))
MIXING = np.array(MIXERS, "u8")[:, None]
#: The lower halves of lanes of 2, 4 and 8 bits.
LANES = tuple(np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))
#: Odd, so that no word's hash is lost where it is rolled up.
ROLL = np.uint64(0xD1342543DE82EF95)
#: Hashes whose remixes are counted at once: they stay in a processor's cache.
AT_ONCE = 4080
#: Sets of fewer common shingles have their share of differing bits counted out; larger ones have the limit's.
SMALL = 33


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle (repeats included), in bounded batches; words are split at ASCII white space, A-Z lowered."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends.tolist()[size - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), STEP):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], last[at : at + STEP], strict=False)], "u8")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: byte-wide sums of 255 rows at a time."""
    pad = -len(h) % 255
    rows = np.concatenate([h, np.zeros(pad, "u8")]).reshape(-1, 255)
    out = np.empty((8, 8), "i8")
    for j in range(8):
        out[:, j] = ((rows >> np.uint64(j)) & ONES).sum(axis=1, dtype="u8").view("u1").reshape(-1, 8).sum(axis=0)
    return out.reshape(64)


def simhash(text: str, size: int = 3) -> int:
    """64 bits; zero for a text without words."""
    count, n = np.zeros(64, "i8"), 0
    for h in shingle_hashes(text, size):
        count += bit_counts(h)
        n += len(h)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes, ascending: each word's XXH64 (words as in ``shingle_hashes``), rolled up over the shingle's words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, "u8")
    for i in range(size):
        h *= ROLL
        h += w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= ROLL
    h ^= h >> np.uint64(29)
    return np.unique(h)


def remixed(h: np.ndarray) -> np.ndarray:
    """The hashes and seven remixes of them, a row each."""
    g = np.empty((1 + len(MIXERS), len(h)), "u8")
    g[0] = h
    x = g[1:]
    np.multiply(h ^ (h >> np.uint64(31)), MIXING, out=x)
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIXERS[0])
    x ^= x >> np.uint64(32)
    return g


def row_bit_counts(g: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each bit. Lanes of 2 bits take three hashes, of 4 bits five of those sums, of 8 bits the rest."""
    k, n = g.shape
    m = -(-n // 15)
    if n < 15 * m:
        g = np.concatenate([g, np.zeros((k, 15 * m - n), "u8")], axis=1)
    x = g.reshape(k, 3, 5, m)
    pairs = np.empty((2, k, 3, 5, m), "u8")
    np.bitwise_and(x, LANES[0], out=pairs[0])
    np.right_shift(x, np.uint64(1), out=pairs[1])
    pairs[1] &= LANES[0]
    x = pairs[:, :, 0] + pairs[:, :, 1]
    x += pairs[:, :, 2]
    fours = np.empty((2, *x.shape), "u8")
    np.bitwise_and(x, LANES[1], out=fours[0])
    np.right_shift(x, np.uint64(2), out=fours[1])
    fours[1] &= LANES[1]
    x = fours[..., 0, :] + fours[..., 1, :]
    for i in (2, 3, 4):
        x += fours[..., i, :]
    bytes_ = np.empty((2, *x.shape), "u8")
    np.bitwise_and(x, LANES[2], out=bytes_[0])
    np.right_shift(x, np.uint64(4), out=bytes_[1])
    bytes_[1] &= LANES[2]
    # axes: bit 2, bit 1, bit 0 of a place in its byte, row, hashes, byte
    count = bytes_.view("u1").reshape(2, 2, 2, k, m, 8).sum(axis=4, dtype="u4")
    return count.transpose(3, 4, 0, 1, 2).reshape(k, 64)


def wide_simhash(shingles: np.ndarray) -> bytes:
    """512 bits of a set of shingle hashes: the hash and seven remixes of it. Repeats don't count, as they don't in similarity."""
    count, n = np.zeros((1 + len(MIXERS), 64), "i8"), len(shingles)
    for at in range(0, n, AT_ONCE):
        count += row_bit_counts(remixed(shingles[at : at + AT_ONCE]))
    return np.packbits(2 * count.reshape(WIDE) > n, bitorder="little").tobytes()


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = down

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """Nodes within the radius, and their distances."""
        wait = [0] if self.values else []
        values, children = self.values, self.children
        while wait:
            at = wait.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at, d
            edges = children[at]
            if edges:
                if len(edges) <= 2 * radius + 1:
                    wait += [c for k, c in edges.items() if -radius <= k - d <= radius]
                else:
                    wait += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]


class Group:
    """Links among the rows of one shard and block: a tree of the block's own rows, past which the others stream.

    Rows at most ``sure`` apart are united at once: each has one link, to a member of its group. Pairs farther apart, up to
    ``radius``, come out as they are, unless their groups are one by then. Only the tree and the groups of its rows are held.
    """

    def __init__(self, radius: int, sure: int) -> None:
        self.radius, self.sure, self.tree = radius, sure, BKTree()
        self.names: list = []  # of the tree's rows
        self.parent: list[int] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def meet(self, name: int | bytes, value: int, kept: bool) -> Iterator[tuple]:
        """(node, node, sure) links of a row to the tree, which it joins if it is the block's own."""
        near, open_ = [], []
        for at, d in self.tree.within(value, self.radius):
            (near if d <= self.sure else open_).append(at)
        roots = sorted({self.root(at) for at in near})
        for r in roots[1:]:
            self.parent[r] = roots[0]
        if roots:
            yield name, self.names[roots[0]], True
        for at in open_:
            if not roots or self.root(at) != roots[0]:
                yield *sorted((self.names[at], name)), False
        if kept and self.tree.add(value) == len(self.names):
            self.names.append(name)
            self.parent.append(roots[0] if roots else len(self.parent))

    def united(self) -> Iterator[tuple]:
        """Links between tree rows whose groups later rows have joined."""
        for i in range(len(self.names)):
            if (r := self.root(i)) != i:
                yield self.names[i], self.names[r], True


def shard_links(shards: DataFrame, radius: int, node: str, sure: int | None = None) -> DataFrame:
    """Links a, b (type ``node``) and whether they are sure, among the rows (key, node, value) of each shard.

    ``value`` is binary, a node has one value; ``sure`` is the radius that needs no other test (None: all of it). A shard above
    ``SHARD`` rows is cut into blocks; each block's tree is met by its own rows and those of later blocks, so no pair is looked at twice and
    no task holds more than one block.
    """
    sure = radius if sure is None else sure
    n = F.ceil(F.col("n") / SHARD).cast("int")
    many = shards.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", n.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = shards.join(many, "key").select("key", "node", "value", own.alias("own"))
    rows = held.select("key", "node", "value", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block")).select("key", "block", (F.col("own") > F.col("block")).alias("guest"), "node", "value")
    placed = rows.repartition(width(shards.sparkSession), "key", "block").sortWithinPartitions("key", "block", "guest", "node")
    kind = pa.int64() if node == "long" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = group = None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            a, b, c = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(c, pa.bool_())], ["a", "b", "sure"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for key, block, guest, x, value in zip(*cols, strict=True):
                if (key, block) != now:
                    if group:
                        out += group.united()
                    now, group = (key, block), Group(radius, sure)
                for link in group.meet(x, int.from_bytes(value, "little"), not guest):
                    out.append(link)
                    if len(out) >= LINKS:
                        yield packed()
        if group:
            out += group.united()
        if out:
            yield packed()

    return placed.mapInArrow(run, f"a {node}, b {node}, sure boolean")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in texts(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([signed(simhash(t, size)) for t in ts], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def near_fingerprints(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links a, b between distinct 64-bit values (column fp) at most ``radius`` bits apart, enough to connect them all.

    Values that differ in at most ``radius`` bits agree on some of the blocks. A shard above ``SHARD`` rows is keyed again, by
    radius + 1 pieces of the bits its values don't yet agree on, of which two such values agree on one; and so on until shards are small or
    have no such bits left. So a crowded shard grows a few rows by each, not by as many as it has blocks.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    bits = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << bits[i + 1]) - 1) ^ ((1 << bits[i]) - 1) for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    shards = keyed(fps, masks)
    settled = []
    while True:
        crowded = shards.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("key")
        finer = {m: [m | piece for piece in pieces(~m & M64, radius + 1)] for m in masks if m != M64}
        if not finer or not crowded.take(1):
            break
        crowded = written(crowded, "crowded")
        settled.append(shards.join(crowded, "key", "left_anti"))
        again = shards.join(crowded, "key", "left_semi")
        parts = [keyed(again.where(F.col("key.mask") == F.lit(signed(m))).select("fp"), ms) for m, ms in finer.items()]
        masks = sorted({m for ms in finer.values() for m in ms})
        shards = written(reduce(DataFrame.union, parts).distinct(), "finer")
    everything = reduce(DataFrame.union, [*settled, shards])
    # hex is big-endian; distances don't depend on the byte order
    return shard_links(everything.select("key", F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("value")), radius, "long")


def pieces(mask: int, n: int) -> list[int]:
    """The set bits of a mask in ``n`` parts, as even as they get."""
    at = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in at[len(at) * k // n : len(at) * (k + 1) // n]) for k in range(n)]


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """key (mask, bits under it) and fp, once a mask."""
    keys = F.array(*(F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for m in masks))
    return fps.select(F.explode(keys).alias("key"), "fp")


def simhash_components(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Null text: no words, fingerprint zero. Fingerprints of equal value are linked. A null doc_id is never the smallest unless
    a component has no other. Repeated rows give repeated rows.
    """
    rows = written(fingerprints(docs, size), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_fingerprints(classes.select("fp"), radius)
    comp = connected_components(links)
    named = classes.join(comp, classes.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = named.join(least, "comp").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes found in several texts of a sample, ascending, and in how many: at most ``COMMON``."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ts,) in texts(batches, "text"):
            for t in ts:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, size).view("i8"), pa.int64())], ["h"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = found.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in got], "i8").view("u8"), np.array([r.n for r in got], "i8")
    order = np.argsort(h)
    return h[order], n[order]


def first_shingles(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """As many of the set, rarest first, that any set of the similarity has one of them among its own first ones."""
    n = len(shingles)
    if not n:
        return shingles
    rank, (h, often) = np.zeros(n, "i8"), common
    if len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        rank = np.where(h[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def differing(both: int, x: int, y: int) -> float:
    """How probably a bit differs between two sets that share ``both`` shingles and have x and y more."""

    def over(n: int, k: float) -> float:
        return sum(math.comb(n, i) for i in range(max(0, math.floor(k) + 1), n + 1)) / 2**n

    out = 0.0
    for c in range(both + 1):
        p, q = over(x, (both + x) / 2 - c), over(y, (both + y) / 2 - c)
        out += math.comb(both, c) / 2**both * (p * (1 - q) + q * (1 - p))
    return out


@cache
def radii(similarity: float, deviations: float = 6.0) -> tuple[int, int]:
    """Bits between wide fingerprints: (up to which pairs are alike beyond doubt, from which they are not).

    A pair of the similarity differs in a share of bits that depends on how many shingles it has, most for few of them (4 in 5:
    0.19; many: 0.15 at 0.8). The second bound is so many standard deviations above the largest share of any size, the first
    as many below the smallest share of pairs that just miss the similarity.
    """
    limit = math.acos(2 * similarity / (1 + similarity)) / math.pi
    high, low = limit, limit
    for both in range(1, SMALL):
        most = int(both * (1 - similarity) / similarity + 1e-9)
        high = max([high, *(differing(both, x, y) for x in range(most + 1) for y in range(x, most - x + 1))])
        low = min([low, *(differing(both, x, n - x) for n in (most + 1, most + 2) for x in range(n // 2 + 1))])
    bits = [WIDE * p + sign * deviations * math.sqrt(WIDE * p * (1 - p)) for p, sign in ((low, -1), (high, 1))]
    return max(0, int(bits[0])), int(bits[1])


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """version and the distinct shingle hashes of the texts whose version is wanted, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vs, ts in texts(batches, "version", "text"):
            sets = [shingle_set(t, size).view("i8") for t in ts]
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["version", "set"])

    own = docs.select(version_column()("text").alias("version"), "text").join(wanted, "version", "left_semi").dropDuplicates(["version"])
    return own.mapInArrow(run, "version binary, set array<long>")


def version_column():
    @F.pandas_udf(T.BinaryType())
    def version(t):
        import pandas as pd

        return pd.Series([text_version(x or "") for x in t])

    return version.asNondeterministic()


def text_version(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, version (hash of the text), class_id and class_version (the class's first document) of every row.

    Texts are near duplicates if the Jaccard similarity of their ``size``-word shingle sets is at least ``similarity``. Fingerprints
    six deviations closer than that similarity makes them are taken at once; pairs up to six deviations farther are held to their
    sets, unless they are united already. Classes are components of those links; the first document has the smallest doc_id (nulls last), then version. Null texts are empty.
    """

    common = common_shingles(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in texts(batches, "doc_id", "text"):
            sets = [shingle_set(t, size) for t in ts]
            versions = [text_version(t) for t in ts]
            same = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else v for h, v in zip(sets, versions, strict=True)]
            first = [first_shingles(h, common, similarity).view("i8") for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.binary()), pa.array(same, pa.binary()), pa.array([wide_simhash(h) for h in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "version", "same", "value", "keys"])

    rows = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, version binary, same binary, value binary, keys array<long>"), "similar")
    # texts of equal sets are one node, named by the version of the first of them
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("first"), "version")).alias("m")
    one = written(rows.groupBy("same").agg(least, F.first("value").alias("value"), F.first("keys").alias("keys")).select("same", "m.version", "m", "value", "keys"), "sets_once")
    spread = one.select("version", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    shards = spread.where("n > 1").select("key", "version").join(one.select("version", "value"), "version").select("key", F.col("version").alias("node"), "value")
    sure, radius = radii(similarity)
    links = written(shard_links(shards, radius, "binary", sure).distinct(), "links")
    open_ = links.where("not sure").select("a", "b")
    sets = written(shingle_sets(docs, open_.select(F.explode(F.array("a", "b")).alias("version")).distinct(), size), "sets")
    a, b = (sets.select(F.col("version").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    same = open_.join(a, "a").join(b, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    comp = connected_components(links.where("sure").select("a", "b").union(same))
    named = one.join(comp, one.version == comp.node, "left").select("same", "m", F.coalesce("component", "version").alias("comp"))
    found = named.join(named.groupBy("comp").agg(F.min("m").alias("least")), "comp").select("same", F.col("least.first").alias("class_id"), F.col("least.version").alias("class_version"))
    return rows.select("doc_id", "version", "same").join(found, "same").select("doc_id", "version", "class_id", "class_version")


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that are their class's first document, one row each, with the same columns.

    Of repeated rows (same doc_id and text) one stays. Columns may have any names. Texts travel in one shuffle, keyed by their
    hash and id.
    """
    found = written(similar_documents(docs, similarity, size), "classes")
    keep = found.where("version = class_version and doc_id <=> class_id").select(F.col("version").alias("_v"), F.col("doc_id").alias("_d")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), version_column()("text").alias("version"), F.col("doc_id").alias("id"))
    kept = own.join(keep, (F.col("version") == F.col("_v")) & F.col("id").eqNullSafe(F.col("_d"))).dropDuplicates(["version", "id"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
