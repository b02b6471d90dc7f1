"""Approximate nearest neighbours over balanced posting lists.

Build: equal vectors are first folded into one (with their six smallest ids: more can't be among five neighbours), so a group
of copies is one entry. Centroids come from balanced two-means on a bounded sample (``SAMPLE`` rows by hash of the id): lists
are split into equal halves until there are as many as wanted, so no list is much larger than another. A graph links each
centroid to its nearest ones, and both assignment and search walk it best-first with a beam, in memory. A vector joins its nearest
list and, as a boundary vector, further lists whose centroid is nearly as close, unless a chosen centroid is closer to that
centroid than the vector is (relative neighbourhood rule).

Search: a query takes its nearest lists up to a beam, those whose centroid distance is within a ratio of the nearest one's. Both
are fitted on sampled rows that the centroids were made without: the beam holds the wanted share of their neighbours in the
sample, the ratio nearly all of those. So data with structure are pruned to a few lists, and data without any take as many as they need.
Many small lists prune better than a few large ones; so that a query isn't sent to each of them, neighbouring lists share a
shard and a query travels once a shard, with the numbers of its lists. A list above ``SHARD_ROWS`` is cut into several shards,
and queries meet a shard in blocks, so that no task holds more than two bounded blocks. Scores are cosines in double precision.

Broadcast: centroids and graph, at most ``MAX_LISTS`` rows, whatever the table's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import width, written

#: Bounds: rows sampled for the centroids, lists (and so broadcast rows), rows and queries that one task holds.
SAMPLE, MAX_LISTS, SHARD_ROWS, QUERY_ROWS = 24_000, 8_192, 20_000, 20_000
#: Sampled rows that fit ratio and beam (at most a fifth of the sample), the least beam, and the entries a query meets at least.
ASKED, LEAST, LEAST_ROWS = 400, 16, 1_000


class Centroids:
    """Balanced two-means tree's leaves, and the neighbour graph over them."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        x = sample.astype("f4")
        # the largest group first; paths keep the tree's order, in which neighbouring lists are near each other
        heap = [(-len(x), "", np.arange(len(x)))]
        while len(heap) < lists and -heap[0][0] >= 4:
            _, path, g = heapq.heappop(heap)
            for side, h in enumerate(self.halves(x, g, rng)):
                heapq.heappush(heap, (-len(h), f"{path}{side}", h))
        groups = [g for _, _, g in sorted(heap, key=lambda h: h[1])]
        c = np.stack([x[g].mean(axis=0) for g in groups]) if len(x) else np.zeros((1, sample.shape[1] or 1), "f4")
        self.c = c.astype("f4")
        k = min(degree, len(c) - 1)
        # in blocks, so that no matrix of all pairs is held
        near = np.concatenate([np.argsort(self.square(self.c[i : i + 512], self.c), axis=1, kind="stable")[:, 1 : k + 1] for i in range(0, len(c), 512)]) if k else np.zeros((len(c), 1), "i8")
        far = rng.integers(0, len(c), (len(c), min(4, len(c))))  # long links keep the graph connected in practice
        self.graph = np.concatenate([near, far], axis=1)
        self.entry = np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype("i8"))

    @staticmethod
    def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)

    @staticmethod
    def halves(x: np.ndarray, g: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        """Two lists of equal size: by the difference of distances to two means."""
        a, b = x[rng.choice(g, 2, replace=False)]
        for _ in range(4):
            side = x[g] @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(g) // 2
            a, b = x[g[order[:half]]].mean(axis=0), x[g[order[half:]]].mean(axis=0)
        return [g[order[:half]], g[order[half:]]]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the ``beam`` nearest centroids of each row, nearest first.

        A step opens a sixteenth of the beam, so that a wide beam doesn't take more steps than a narrow one.
        """
        if len(q) > 128:  # a bounded block of rows at a time
            parts = [self.search(q[i : i + 128], beam) for i in range(0, len(q), 128)]
            most = min(a.shape[1] for a, _ in parts)
            return np.concatenate([a[:, :most] for a, _ in parts]), np.concatenate([d[:, :most] for _, d in parts])
        q = q.astype("f4")
        n, lists = len(q), len(self.c)
        beam = min(beam, lists)
        norm = (q * q).sum(1)[:, None]
        size = (self.c * self.c).sum(1)

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.maximum(norm + size[ids] - 2 * np.einsum("nkd,nd->nk", self.c[ids], q), 0)

        seen = np.zeros((n, lists), bool)
        rows = np.arange(n)[:, None]
        ids = np.tile(self.entry, (n, 1))
        seen[rows, ids] = True
        dist, done = distance(ids), np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
            open_ = np.where(done, np.inf, dist)
            take = min(max(4, beam // 16), ids.shape[1])
            step = np.argpartition(open_, take - 1, axis=1)[:, :take]
            alive = np.isfinite(open_[rows, step])
            if not alive.any():
                break
            done[rows, step] = True
            new = self.graph[ids[rows, step]].reshape(n, -1)
            fresh = ~seen[rows, new] & np.repeat(alive, self.graph.shape[1], axis=1)
            new_sorted = np.sort(np.where(fresh, new, lists), axis=1)
            fresh = (new_sorted < lists) & np.concatenate([np.ones((n, 1), bool), new_sorted[:, 1:] != new_sorted[:, :-1]], axis=1)
            new = np.where(fresh, new_sorted, 0)
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            d = np.full(new.shape, np.inf, "f4")
            far = norm[r, 0] + size[new[r, c]] - 2 * np.einsum("md,md->m", self.c[new[r, c]], q[r])
            d[r, c] = np.maximum(far, 0)
            ids, dist, done = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], dist[rows, order]

    def assign(self, x: np.ndarray, copies: int = 2, slack: float = 1.15, apart: float = 0.1, beam: int = 16) -> list[list[int]]:
        """The nearest list, and up to ``copies`` in all whose centroid is nearly as close and not beside a chosen one."""
        ids, dist = self.search(x, beam)
        out = []
        for row, d in zip(ids.tolist(), dist.tolist(), strict=True):
            chosen = [row[0]]
            for i, e in zip(row[1:], d[1:], strict=True):
                if e > slack**2 * d[0] + 1e-12 or len(chosen) == copies:
                    break
                if all(((self.c[i] - self.c[j]) ** 2).sum() > e * apart for j in chosen):
                    chosen.append(i)
            out.append(chosen)
        return out

    def lists_for(self, q: np.ndarray, ratio: float, beam: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """Distance-ratio pruning: of the nearest ``beam`` lists those whose centroid is within ``ratio`` of the nearest one's distance.

        With ``sizes`` farther lists are added until they hold ``least`` entries, so that no query goes short.
        """
        ids, dist = self.search(q, max(2 * beam, 48))  # the walk finds the nearest of a wider beam nearly always
        keep = np.arange(ids.shape[1]) < beam
        keep = keep & (dist <= ratio**2 * np.maximum(dist[:, :1], 1e-12) + 1e-12)
        if sizes is not None:
            held = sizes[ids]
            keep |= np.cumsum(held, axis=1) - held < least
        keep &= np.isfinite(dist)
        return [row[k].tolist() for row, k in zip(ids, keep, strict=True)]

    def fitted(self, asked: np.ndarray, sample: np.ndarray, k: int, wanted: float, copies: int) -> tuple[float, int]:
        """(ratio, beam) for rows that the centroids were made without: nearest lists up to ``beam`` hold a ``wanted`` share of their
        neighbours in the sample, and all but one in a hundred of those are within ``ratio``."""
        if not len(asked) or len(sample) <= k or len(self.c) < 2:
            return 1e6, LEAST
        need, far = [], []
        for at in range(0, len(asked), 64):
            q = asked[at : at + 64]
            dist = self.square(q.astype("f4"), self.c)
            ids = np.argsort(dist, axis=1, kind="stable")
            dist, place = np.take_along_axis(dist, ids, axis=1), np.empty_like(ids)
            np.put_along_axis(place, ids, np.broadcast_to(np.arange(ids.shape[1]), ids.shape), axis=1)
            top = np.argpartition(-(q @ sample.T), k - 1, axis=1)[:, :k]
            for i, lists in enumerate(self.assign(sample[top.ravel()], copies)):
                first = min(place[i // k, j] for j in lists)
                need.append(first)
                far.append(float(np.sqrt(dist[i // k, first] / max(dist[i // k, 0], 1e-12))))
        return float(np.quantile(far, 0.99)), max(LEAST, int(np.quantile(need, wanted)) + 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part: a non-null id, and no null, empty or zero vector, no null or non-finite component."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(v.isNotNull() & F.col("id").isNotNull()).where(ok)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two to a largest component of about 1: exact, and no square over- or underflows to nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(column: np.ndarray | list, dim: int) -> np.ndarray:
    x = scaled(np.array(column, "f8").reshape(-1, dim))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors_of(t: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles, without going through Python objects."""
    c = t.column("v")
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.asarray(c.flatten()).astype("f8").reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", list_rows: int = 12, wanted: float = 0.97, copies: int = 2, lists: int | None = None, report: dict | None = None) -> DataFrame:
    """The ``k`` nearest found of each query row (id divisible by ``every``) among all other rows, by cosine.

    query_id, rank, vec_id, score; ties of score go to the smaller id. Rows of another length than the commonest (ties: the
    longest) take no part, as their cosine isn't defined; see ``usable`` for the others. A repeated id counts as one row a
    distinct vector. Other columns are ignored. No queries or no candidates: no rows.

    ``list_rows`` is how many rows a list has while there are fewer than ``MAX_LISTS``; ``wanted`` the share of neighbours that
    the fitted beam holds on the sample. ``report`` is filled with lists, ratio, beam and the share of entries scored a query.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = int(sizes["d"]), int(sizes["count"])
    rows = rows.where(F.size("v") == dim).distinct()
    # copies: the k+1 smallest ids of each distinct vector are enough, as a query may be one of them
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    folded = written(kept.groupBy("v").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    sample = unit(vectors_of(folded.orderBy(F.xxhash64("key"), "key").select("v").limit(SAMPLE).toArrow(), dim), dim)
    n_lists = lists or int(min(MAX_LISTS, max(1, total // list_rows), max(1, len(sample) // 5)))
    aside = min(ASKED, len(sample) // 5)
    index = Centroids(sample[aside:], n_lists)
    ratio, beam = index.fitted(sample[:aside], sample[aside:], k, wanted, copies)
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS rows

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = shared.value.assign(unit(vectors_of(b, dim), dim), copies)
                t = b.take(pa.array(np.repeat(np.arange(b.num_rows), [len(a) for a in at])))
                yield pa.RecordBatch.from_arrays([pa.array([i for a in at for i in a], pa.int32()), t.column("key"), t.column("ids"), t.column("v")], ["list", "key", "ids", "v"])

    posted = written(folded.select("key", "ids", "v").mapInArrow(post, "list int, key long, ids array<long>, v array<double>"), "postings")
    counts = {r.list: r.n for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    held = np.array([counts.get(i, 0) for i in range(len(index.c))])
    base, shares = shards_of(held, 2 * width(spark))
    asking = rows.where(F.col("id") % every == 0).repartition(width(spark))
    blocks = -(-asking.count() // QUERY_ROWS) or 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = shared.value.lists_for(unit(vectors_of(b, dim), dim), ratio, beam, held, LEAST_ROWS)
                take, where, which = [], [], []
                for i, chosen in enumerate(at):
                    by: dict[int, list[int]] = {}
                    for j in chosen:
                        for s in range(base[j], base[j] + shares[j]):
                            by.setdefault(s, []).append(j)
                    take += [i] * len(by)
                    where += by.keys()
                    which += by.values()
                t = b.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(which, pa.list_(pa.int32())), t.column("id"), t.column("v")], ["shard", "lists", "id", "v"])

    if report is not None:
        size = F.udf(lambda x: int(sum(held[j] for j in x if base[j] == base[x[0]] or shares[j] == 1)), "long")
        work = asking.mapInArrow(ask, "shard int, lists array<int>, id long, v array<double>").where(F.array_min("lists") >= 0).agg(F.sum(size("lists")).alias("n")).first().n or 0
        report |= {"lists": len(index.c), "ratio": ratio, "beam": beam, "shards": int(max(base + shares)), "share": work / max(1, asking.count() * folded.count())}
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    queries = asking.mapInArrow(ask, "shard int, lists array<int>, id long, v array<double>").select("shard", block.alias("block"), "lists", "id", "v")
    place = F.broadcast(spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(base, shares, strict=True))], "list int, base int, shares int"))  # at most MAX_LISTS rows
    shard = F.col("base") + F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")
    entries = posted.join(place, "list").select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "list", "key", "ids", "v")

    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if right.num_rows and left.num_rows:
            right = right.sort_by("list")
            x = scaled(vectors_of(right, dim))
            size = np.sqrt((x * x).sum(1))
            ids = right.column("ids").to_pylist()
            lists_, starts, lengths = np.unique(right.column("list").to_numpy(), return_index=True, return_counts=True)
            q = scaled(vectors_of(left, dim))
            norm = np.sqrt((q * q).sum(1))
            for i, (own, chosen) in enumerate(zip(left.column("id").to_pylist(), left.column("lists").to_pylist(), strict=True)):
                at = np.isin(lists_, chosen, assume_unique=True)
                n = lengths[at]
                near = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                if not len(near):
                    continue
                y = x[near]
                s = (y @ q[i]) / size[near]
                m = min(len(near), 2 * k + 2)
                least = np.partition(s, len(s) - m)[len(s) - m] - 1e-12 * norm[i]
                top = s >= least  # all that share the last place
                near = near[top]
                exact = np.einsum("md,d->m", y[top], q[i]) / (size[near] * norm[i])
                best = sorted({(-v, c) for v, j in zip(exact.tolist(), near.tolist(), strict=True) for c in ids[j] if c != own})[:k]
                out += [(own, c, -v) for v, c in best]
        cols = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, found, strict=True)], schema=found)

    pairs = queries.groupBy("shard", "block").cogroup(entries.groupBy("shard", "block")).applyInArrow(score, "query_id long, vec_id long, score double")
    # a candidate may come from several lists; its score is the same in each
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shards_of(held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each list: lists in order fill shards up to a bound, at least about ``least`` of them; larger lists have their own."""
    most = int(min(SHARD_ROWS, max(1, held.sum() // least)))
    base, shares, at, used = np.zeros(len(held), "i8"), np.ones(len(held), "i8"), 0, 0
    for i, n in enumerate(held.tolist()):
        if n > SHARD_ROWS:
            at += used > 0
            base[i], shares[i], used = at, -(-n // SHARD_ROWS), 0
            at += int(shares[i])
            continue
        if used and used + n > most:
            at, used = at + 1, 0
        base[i] = at
        used += n
    return base, shares


def recall(found: DataFrame, vectors: DataFrame, k: int = 5, every: int = 50) -> float:
    """Share of the exact nearest ids that were found; exact ones by brute force on the driver (for tests and small tables)."""
    pdf: pd.DataFrame = usable(vectors, "vec_id", "embedding").toPandas()
    x, ids = unit(pdf["v"].tolist(), len(pdf["v"].iloc[0])), pdf["id"].to_numpy()
    got = {q: set(g["vec_id"]) for q, g in found.toPandas().groupby("query_id")}
    hit = all_ = 0
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -np.round(s, 12)))[:k]].tolist())
        hit += len(best & got.get(int(ids[i]), set()))
        all_ += len(best)
    return hit / max(all_, 1)
