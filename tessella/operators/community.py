"""Communities: detection, splitting, cohesion, labels, fingerprints, stable ids."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import usable_weight
from tessella.plans.materialize import written

from . import spread
from .topology import both_ways, project, record_degree

#: Nodes up to which modularity is optimised on the driver (integers and weights only), ten times as many pairs; larger graphs by passes over their links.
LOCAL = 200_000


def louvain(links: dict[int, dict[int, float]], resolution: float = 1.0, levels: int = 10, gain_least: float = 1e-4, inner: dict[int, float] | None = None) -> dict[int, int]:
    """Modularity by local moves and aggregation; nodes in order, ties to the smaller community, so the result is deterministic. ``inner``: weight inside a node."""
    home = {n: n for n in links}
    graph = {n: dict(e) for n, e in links.items()}
    loops = dict(inner) if inner else dict.fromkeys(graph, 0.0)
    for _ in range(levels):
        total = sum(w for e in graph.values() for w in e.values()) + 2 * sum(loops.values())
        if total <= 0:
            break
        size = {n: sum(e.values()) + 2 * loops[n] for n, e in graph.items()}
        where, volume, moved_any = {n: n for n in graph}, dict(size), False
        for _ in range(50):
            gained = 0.0
            for n in sorted(graph):
                near: dict[int, float] = defaultdict(float)
                for m, w in graph[n].items():
                    near[where[m]] += w
                own = where[n]
                volume[own] -= size[n]
                stay = near.get(own, 0.0) - resolution * volume[own] * size[n] / total
                best, value = own, stay
                for c in sorted(near):
                    v = near[c] - resolution * volume[c] * size[n] / total
                    if v > value + 1e-12:
                        best, value = c, v
                volume[best] += size[n]
                if best != own:
                    where[n], moved_any = best, True
                    gained += 2 * (value - stay) / total
            if gained <= gain_least:
                break
        if not moved_any:
            break
        home = {n: where[c] for n, c in home.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(where.values())}
        inner = dict.fromkeys(merged, 0.0)
        for n, e in graph.items():
            inner[where[n]] += loops[n]
            for m, w in e.items():
                a, b = where[n], where[m]
                if a == b:
                    inner[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        graph, loops = merged, inner
    return home


def _local(names: list[str], pairs: list[tuple[str, str, float]], resolution: float, part: float, least: int, loose: float, loose_size: int) -> list[list[str]]:
    at = {n: i for i, n in enumerate(names)}
    links: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
    for a, b, w in pairs:
        links[at[a]][at[b]] = links[at[b]][at[a]] = w
    if not any(w for e in links.values() for w in e.values()):
        links = {n: dict.fromkeys(e, 1.0) for n, e in links.items()}

    def split(members: list[int]) -> list[list[int]]:
        inside = set(members)
        groups: dict[int, list[int]] = defaultdict(list)
        for n, c in louvain({n: {m: w for m, w in links[n].items() if m in inside} for n in members}, resolution).items():
            groups[c].append(n)
        return list(groups.values())

    def cohesive(members: list[int]) -> float:
        inside, n = set(members), len(members)
        return sum(m in inside for x in members for m in links[x]) / (n * (n - 1)) if n > 1 else 1.0

    found = split([n for n in links if links[n]]) + [[n] for n in links if not links[n]]
    limit = max(least, int(part * len(names)))
    found = [s for g in found for s in (split(g) if len(g) > limit else [g])]
    found = [s for g in found for s in (split(g) if len(g) >= loose_size and cohesive(g) < loose else [g])]
    return sorted((sorted(names[i] for i in g) for g in found), key=lambda g: (-len(g), g))


def communities(nodes: DataFrame, edges: DataFrame, multigraph: bool = True, resolution: float = 1.0, hubs_percentile: float | None = None, method: str = "modularity", local: int | None = None) -> DataFrame:
    """id, community: 0 is the largest (ties: smaller members), isolates alone.

    Multigraphs are projected by confidence, others keep their usable weights. Hubs above a degree percentile are left out and
    then join their neighbours' commonest community. Oversized groups (a quarter of the nodes, ten at least) and loose large ones
    are split again. That is ``method`` modularity: on the driver up to ``LOCAL`` nodes and ten times as many pairs, above by
    passes in which half of the nodes move at once, without hubs. A bound given as ``local`` refuses above it. The method labels
    is label propagation, numbered alike, for which resolution and hubs have no meaning and are refused.
    """
    if method not in ("modularity", "labels"):
        raise ValueError("method is modularity or labels")
    if method == "labels" and (resolution != 1.0 or hubs_percentile is not None):
        raise ValueError("label propagation has neither a resolution nor hubs")
    pairs = project(edges, "confidence") if multigraph else edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max(usable_weight(F.col("weight"))).alias("weight"))
    live = nodes.select("id").distinct()
    if method == "labels":
        ids = numbered(live, "id")
        n, links = ids.count(), spread.encoded(ids, pairs)
        home = spread.labels(links, n)
        links.unpersist()
        return spread.named(ids, spread.ranked(home))
    pairs = written(pairs.select("a", "b", "weight").join(live.withColumnRenamed("id", "a"), "a", "left_semi").join(live.withColumnRenamed("id", "b"), "b", "left_semi"), "pairs")
    n, most = live.count(), LOCAL if local is None else local
    if n > most or pairs.count() > 10 * most:
        if local is not None:
            raise ValueError(f"modularity is limited to {local} nodes here; use the method labels or no bound")
        if hubs_percentile is not None:
            raise ValueError(f"hubs are left out only up to {LOCAL} nodes")
        ids = numbered(live, "id")
        links = spread.encoded(ids, pairs)
        home = spread.detect(links, n, resolution, 0.25, 10, 0.05, 50)
        links.unpersist()
        return spread.named(ids, spread.ranked(home))
    names = sorted(r.id for r in live.collect())  # at most ``most`` ids
    links = sorted((r.a, r.b, float(r.weight)) for r in pairs.collect())
    hubs: set[str] = set()
    if hubs_percentile is not None and names:
        degree = Counter(x for a, b, _ in links for x in (a, b))
        sizes_ = sorted(degree[x] for x in names)
        gate = sizes_[max(0, int(len(sizes_) * hubs_percentile / 100) - 1)]
        hubs = {x for x in names if degree[x] > gate}
    groups = _local([x for x in names if x not in hubs], [p for p in links if p[0] not in hubs and p[1] not in hubs], resolution, 0.25, 10, 0.05, 50)
    home = {x: i for i, g in enumerate(groups) for x in g}
    for h in sorted(hubs):
        votes = Counter(home[y] for a, b, _ in links for x, y in ((a, b), (b, a)) if x == h and y in home)
        if votes:
            home[h] = min(votes, key=lambda c: (-votes[c], c))
            groups[home[h]].append(h)
        else:
            home[h] = len(groups)
            groups.append([h])
    groups = sorted((sorted(g) for g in groups), key=lambda g: (-len(g), g))
    return nodes.sparkSession.createDataFrame([(x, i) for i, g in enumerate(groups) for x in g], "id string, community long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``number``, 0 and up in an order over all rows: sorted in parallel, the driver holds one count a partition."""
    placed = written(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    before, starts = 0, {}
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts[r.p], before = before, before + r.n
    if not starts:
        return placed.withColumn("number", F.col("_m")).drop("_m")
    first = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv])
    return placed.withColumn("number", first[part] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, cohesion: simple edges inside over all possible ones; 1.0 for one node."""
    c = nodes.select("id", "community").where("community is not null")
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inner = pairs.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("e"))
    size = c.groupBy("community").agg(F.count("*").alias("size"))
    n = F.col("size")
    return size.join(inner, "community", "left").select("community", "size", F.when(n <= 1, 1.0).otherwise(F.coalesce("e", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"))


def hub_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """community and the label of its member with most edge records (ties: smaller id), without call brackets."""
    d = nodes.join(record_degree(nodes, edges), "id").where("community is not null")
    best = d.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", "label")).alias("m"))
    return best.select("community", F.regexp_replace(F.coalesce("m.label", "m.id"), r"\(\)$", "").alias("label"))


def signatures(nodes: DataFrame) -> DataFrame:
    """community and the first 16 hex digits of a hash of its sorted members, folded from member hashes: no list is gathered."""
    return nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string"), F.min("id"), F.max("id")), 256), 1, 16).alias("signature"))


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and how many communities its neighbours belong to, other than its own."""
    c = nodes.select("id", "community")
    near = both_ways(edges).where("a <> b").distinct().join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").where("cb is not null and not (ca <=> cb)")
    n = near.select("a", "cb").distinct().groupBy("a").agg(F.count("*").alias("reach"))
    return nodes.select("id").join(n, nodes.id == n.a, "left").select("id", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"))


def cross_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """community, other, links: edge records between two communities, seen from both."""
    c = nodes.select("id", "community").where("community is not null")
    j = edges.join(c.select(F.col("id").alias("source"), F.col("community").alias("cu")), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("cv")), "target").where("cu <> cv")
    one = j.groupBy("cu", "cv").agg(F.count("*").alias("n"))
    return one.select(F.col("cu").alias("community"), F.col("cv").alias("other"), "n").union(one.select("cv", "cu", "n")).groupBy("community", "other").agg(F.sum("n").alias("links"))


def assign(score: dict[tuple[int, int], int]) -> dict[int, int]:
    """Largest total score of a one-to-one matching (old, new), by successive best augmenting paths; new -> old."""
    olds, news = sorted({a for a, _ in score}), sorted({b for _, b in score})
    match: dict[int, int] = {}  # new -> old
    for start in olds:
        # best gain of a chain old -> new (-> old -> new)*: Bellman-Ford over the current matching
        gain, came = {("o", start): 0}, {}
        for _ in range(len(olds) + len(news)):
            changed = False
            for (a, b), s in score.items():
                if ("o", a) in gain and match.get(b) != a and gain[("o", a)] + s > gain.get(("n", b), -1):
                    gain[("n", b)], came[("n", b)] = gain[("o", a)] + s, a
                    changed = True
            for b, a in match.items():
                if ("n", b) in gain and a != start and gain[("n", b)] - score[a, b] > gain.get(("o", a), float("-inf")):
                    gain[("o", a)], came[("o", a)] = gain[("n", b)] - score[a, b], b
                    changed = True
            if not changed:
                break
        ends = [("n", b) for b in news if ("n", b) in gain and b not in match] + [k for k in gain if k[0] == "o"]
        end = max(ends, key=lambda k: (gain[k], k[0] == "o", -k[1]))
        if gain[end] <= 0:
            continue
        at = end
        if at[0] == "o":
            at = ("n", came[at])
        while True:
            a = came[at]
            match[at[1]] = a
            if a == start:
                break
            at = ("n", came[("o", a)])
    return match


def remap(new: DataFrame, old: DataFrame, most: int = 50_000) -> DataFrame:
    """id, community with ids of an earlier assignment kept where they overlap most; new ids are ones not used before.

    Overlaps are one join and aggregate; the matching runs on the overlap counts, of which there are as many as community pairs:
    more than ``most`` are refused.
    """
    pairs = new.join(old.withColumnRenamed("community", "old"), "id").groupBy("old", "community").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} overlapping communities")
    match = assign({(r.old, r.community): r.n for r in pairs})
    used = {r.community for r in old.select("community").distinct().collect()}
    rest = [r.community for r in new.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("i")).orderBy(F.desc("n"), "i").collect() if r.community not in match]
    free = (i for i in range(len(used) + len(rest) + 1) if i not in used)
    table = [(int(c), int(o)) for c, o in match.items()] + [(int(c), int(next(free))) for c in rest]
    names = new.sparkSession.createDataFrame(table, "community long, final long")
    return new.join(names, "community").select("id", F.col("final").alias("community"))


def betweenness(nodes: DataFrame, edges: DataFrame, most: int = 5000, sample: int | None = None, most_pairs: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(id, score) and (a, b, score): shortest-path dependencies by source, sources spread over tasks with the adjacency
    broadcast; refused above ``most`` nodes or ``most_pairs`` pairs between them, which bounds the broadcast.

    Exact, or from ``sample`` sources (by hash of the id) scaled up to all."""
    from collections.abc import Iterator

    import pandas as pd

    spark = nodes.sparkSession
    n = nodes.select("id").distinct().count()
    if n > most:
        raise ValueError(f"exact betweenness is limited to {most} nodes")
    ids = nodes.select("id").distinct()
    inner = both_ways(edges).where("a <> b").distinct().join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    inner = inner.limit(2 * most_pairs + 1).collect()
    if len(inner) > 2 * most_pairs:
        raise ValueError(f"betweenness is limited to {most_pairs} pairs")
    near: dict[str, list[str]] = defaultdict(list)
    for r in inner:
        near[r.a].append(r.b)
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj = shared.value
        for b in batches:
            rows: list[tuple] = []
            for s in b["id"]:
                order, paths, dist, before = [], {s: 1.0}, {s: 0}, defaultdict(list)
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before[w].append(v)
                share: dict[str, float] = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        c = paths[v] / paths[w] * (1 + share[w])
                        share[v] += c
                        rows.append((min(v, w), max(v, w), c))
                    if w != s:
                        rows.append((w, "", share[w]))
            yield pd.DataFrame(rows, columns=["a", "b", "c"])

    sources = ids if sample is None or n <= sample else ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    up = n / min(n, sample or n) if n else 1.0
    part = sources.repartition(max(1, min(64, n))).mapInPandas(run, "a string, b string, c double").groupBy("a", "b").agg((F.sum("c") * (up / 2)).alias("score"))
    part = written(part, "betweenness")
    scored = part.where("b = ''").select(F.col("a").alias("id"), "score")
    return ids.join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), part.where("b <> ''").select("a", "b", "score")
