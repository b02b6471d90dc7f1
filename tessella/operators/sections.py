"""Sections and hierarchies: edge classes, summaries, participation, directory rollups, keywords, flow chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def include_edge(confidence: Column, score: Column) -> Column:
    return (confidence == "EXTRACTED") | ((confidence == "INFERRED") & (F.coalesce(score, F.lit(0.0)) >= 0.85))


def classify(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Adds a, b (sections of the ends) and kind: intra, inter or orphan. ``home``: id, section."""
    j = edges.join(home.select(F.col("id").alias("source"), F.col("section").alias("a")), "source", "left").join(home.select(F.col("id").alias("target"), F.col("section").alias("b")), "target", "left")
    return j.withColumn("kind", F.when(F.col("a").isNull() | F.col("b").isNull(), "orphan").when(F.col("a") == F.col("b"), "intra").otherwise("inter"))


def between(classified: DataFrame) -> DataFrame:
    """a, b, count and the commonest relation (ties: the smaller name) of edges between sections."""
    n = classified.where("kind = 'inter'").groupBy("a", "b", "relation").agg(F.count("*").alias("n"))
    return n.groupBy("a", "b").agg(F.sum("n").alias("count"), F.min(F.struct((-F.col("n")).alias("n"), "relation")).alias("m")).select("a", "b", "count", F.col("m.relation").alias("relation"))


def participation(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score: edge scores summed over both ends; calls weigh most, structure least."""
    w = weights or {"calls": 3.0, "uses": 2.0, "imports": 1.0, "contains": 0.5}
    score = F.coalesce(F.create_map(*[F.lit(x) for kv in w.items() for x in kv])[F.col("relation")], F.lit(1.0)) * F.when(F.col("confidence") == "EXTRACTED", 1.0).otherwise(0.5)
    e = edges.select(F.explode(F.array("source", "target")).alias("id"), score.alias("s"))
    return e.groupBy("id").agg(F.sum("s").alias("score"))


def entries(edges: DataFrame, top: int = 10) -> DataFrame:
    """Likely entry points: most outgoing less incoming edges (ties: id)."""
    e = edges.select(F.col("source").alias("id"), F.lit(1).alias("d")).union(edges.select("target", F.lit(-1)))
    return e.groupBy("id").agg(F.sum("d").alias("lead")).orderBy(F.desc("lead"), "id").limit(top)


def path_rollup(paths: DataFrame, column: str = "path") -> DataFrame:
    """prefix, depth, files, items for every folder above the given paths: a rollup over path prefixes, counted from distinct paths up.

    Paths repeat rarely at the leaves and often at the root, so equal paths are counted before prefixes are exploded.
    """
    n = paths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("p")).agg(F.count("*").alias("n"))
    parts = F.split("p", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), i.alias("depth")))
    return n.select("n", F.explode(prefix).alias("x")).groupBy("x.prefix", "x.depth").agg(F.count("*").alias("files"), F.sum("n").alias("items"))


def keywords(labels: DataFrame, top: int = 5) -> DataFrame:
    """section, word, n, rank: commonest words of more than two letters in the labels of a section (ties: the smaller word)."""
    w = labels.select("section", F.explode(F.regexp_extract_all(F.lower("label"), F.lit(r"[a-z]{3,}"), 0)).alias("word")).groupBy("section", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("section").orderBy(F.desc("n"), "word")
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def archetypes(communities: DataFrame, kinds: dict[str, list[str]], least: int = 2) -> DataFrame:
    """community, section: the kind whose keywords occur most in its labels (ties: the earlier kind); none below ``least``."""
    text = F.lower("label")
    counts = [F.sum(sum((F.regexp_count(text, F.lit(k)) for k in ks[1:]), F.regexp_count(text, F.lit(ks[0])))).alias(name) for name, ks in kinds.items()]
    g = communities.groupBy("community").agg(*counts)
    best = F.greatest(*kinds) if len(kinds) > 1 else F.col(next(iter(kinds)))
    pick = F.coalesce(*(F.when((F.col(k) == best) & (best >= least), F.lit(k)) for k in kinds))
    return g.select("community", F.coalesce(pick, F.lit("other")).alias("section"), best.alias("score"))


def flow_chain(links: list[tuple[str, str, int]], most: int = 7) -> list[str]:
    """A chain of sections from the one least pointed at, along the heaviest link to one not seen; links are section pairs, so few."""
    names = sorted({x for a, b, _ in links for x in (a, b)})
    if not names:
        return []
    coming = {n: sum(w for _, b, w in links if b == n) for n in names}
    at = min(names, key=lambda n: (coming[n], n))
    chain = [at]
    while len(chain) < most:
        ahead = [(w, b) for a, b, w in links if a == at and b not in chain]
        if not ahead:
            break
        at = min(ahead, key=lambda x: (-x[0], x[1]))[1]
        chain.append(at)
    return chain


def common_root(paths: DataFrame, column: str = "path") -> str:
    """The folder that all paths share: the common part of the smallest and the largest."""
    row = paths.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if not row.a:
        return ""
    a, b, out = row.a.split("/")[:-1], row.b.split("/")[:-1], []
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        out.append(x)
    return "/".join(out)
