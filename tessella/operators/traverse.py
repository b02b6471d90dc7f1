"""Traversals as bounded iterations of equi-joins; each level is written, so a lost executor never unwinds the loop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import written

from .topology import both_ways, distinct_degree

#: Relations along which a change spreads to its users.
USES = "calls embeds extends implements imports imports_from indirect_call inherits mixes_in re_exports references uses".split()


def hub_gate(degrees: DataFrame, floor: int = 50) -> int:
    """The degree at index int(0.99 n) in sorted order, at least ``floor``: from a histogram of degrees, not a sort of nodes."""
    n = degrees.count()
    if not n:
        return floor
    seen = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))  # one row a distinct degree
    at = degrees.groupBy("degree").agg(F.count("*").alias("n")).withColumn("upto", seen).where(F.col("upto") > int(0.99 * n)).agg(F.min("degree")).first()[0]
    return max(floor, int(at))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, gated: bool = True, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion: (id, level) and (level, source, target).

    A layer becomes visited only when it is complete, so a node met from two parents of one layer gives two edges. Nodes that
    aren't seeds and have at least the gate's degree are reported but not expanded. ``pairs``: both ways of the edges, distinct.
    """
    pairs = written(both_ways(edges).distinct(), "near") if pairs is None else pairs  # every level and the degrees read it, none builds it again
    near = pairs.where("a <> b")
    closed = None
    if gated:
        degrees = written(distinct_degree(nodes, edges, pairs), "degrees")
        closed = written(degrees.where(F.col("degree") >= hub_gate(degrees)).select("id"), "hubs")
    visited = written(seeds.select("id").distinct().withColumn("level", F.lit(0)), "bfs")
    found = None
    for level in range(1, depth + 1):
        front = visited.where(F.col("level") == level - 1).select("id")
        if gated and level > 1:
            front = front.join(closed, "id", "left_anti")
        step = near.join(front, near.a == front.id).select(F.col("a").alias("source"), F.col("b").alias("target"))
        step = written(step.join(visited.select(F.col("id").alias("target")), "target", "left_anti").select(F.lit(level).alias("level"), "source", "target"), "bfs")
        if not step.take(1):
            break
        found = step if found is None else found.unionByName(step)
        visited = visited.unionByName(step.select(F.col("target").alias("id"), "level").distinct())
    if found is None:
        found = visited.sparkSession.createDataFrame([], "level int, source string, target string")
    return visited, found


def expand_depth_first(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 200_000) -> DataFrame:
    """order, id in depth-first order. Visiting is sequential by definition, so the walk runs in one task over the seeds'
    ``depth``-hop surroundings, found by joins; above ``most`` edges it raises instead of cutting."""
    ball, _ = expand(nodes, edges, seeds, depth, gated=False)
    near = both_ways(edges).where("a <> b").distinct()
    inner = near.join(ball.select(F.col("id").alias("a")), "a", "left_semi").join(ball.select(F.col("id").alias("b")), "b", "left_semi")
    inner = written(inner, "dfs")
    if inner.count() > most:
        raise ValueError("the surroundings are too large for a sequential walk; lower the depth")
    degrees = distinct_degree(nodes, edges)
    gate = hub_gate(degrees)
    closed = degrees.where(F.col("degree") >= gate).select(F.col("id").alias("b"), F.lit(True).alias("closed"))
    starts = sorted(r.id for r in seeds.select("id").distinct().collect())  # a question's few seeds
    rows = inner.join(closed, "b", "left").select("a", "b", F.coalesce("closed", F.lit(False)).alias("closed"), F.lit(0).alias("g"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near_of: dict[str, list[str]] = {}
        hubs = set(pdf.loc[pdf["closed"], "b"])
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near_of.setdefault(a, []).append(b)
        return pd.DataFrame(list(enumerate(depth_first(near_of, starts, hubs, depth))), columns=["order", "id"])

    out = rows.groupBy("g").applyInPandas(walk, "order int, id string")
    return out if inner.take(1) else seeds.sparkSession.createDataFrame(list(enumerate(starts)), "order int, id string")


def depth_first(near: dict[str, list[str]], seeds: list[str], hubs: set[str], depth: int) -> Iterator[str]:
    """Visited when taken from the stack, with the depth it then has; hubs that aren't seeds aren't expanded."""
    seen: set[str] = set()
    stack = [(s, 0) for s in sorted(seeds, reverse=True)]
    while stack:
        node, d = stack.pop()
        if node in seen or d > depth:
            continue
        seen.add(node)
        yield node
        if node in hubs and node not in seeds:
            continue
        stack += [(x, d + 1) for x in sorted(set(near.get(node, ())), reverse=True) if x not in seen]


def affected(edges: DataFrame, seed: str, depth: int = 2, relations: list[str] | None = None) -> DataFrame:
    """Who is reached from a seed against the edges: id, depth, and the smallest relation of the first hit; without the seed."""
    e = edges.where(F.col("relation").isin(*(relations or USES))).select(F.col("source").alias("who"), F.col("target").alias("of"), "relation")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(seed, 0, "")], "id string, depth int, relation string")
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).select(F.col("id").alias("of"))
        step = e.join(front, "of").groupBy(F.col("who").alias("id")).agg(F.min("relation").alias("relation"))
        step = written(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "relation"), "affected")
        if not step.take(1):
            break
        seen = seen.unionByName(step)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 8) -> DataFrame:
    """hop, id along the least path (by ids) among the shortest undirected ones; empty if there is none within ``most`` hops.

    The search goes level by level and keeps one row a node with its least parent path, so the result is the lexicographically
    smallest: a prefix of a least path is itself the least path to its end.
    """
    spark = edges.sparkSession
    near = written(both_ways(edges).where("a <> b").distinct(), "near")
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen = front.select("id")
    for _ in range(most + 1):
        hit = front.where(F.col("id") == target)
        if row := hit.agg(F.min("path").alias("p")).first().p:
            return spark.createDataFrame([(i, x) for i, x in enumerate(row)], "hop int, id string")
        step = near.join(front, near.a == front.id).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = written(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "path")
        if not front.take(1):
            break
        seen = seen.unionByName(front.select("id"))
    return spark.createDataFrame([], "hop int, id string")


def cycles(pairs: DataFrame, longest: int = 5, top: int | None = 20) -> DataFrame:
    """Simple directed cycles of at most ``longest`` nodes, each once, started at its smallest node: length and nodes.

    ``pairs`` has source and target. Chains only pass nodes larger than their start, which both bounds them and makes rotations
    of one cycle a single row. ``top`` keeps the shortest (it is the report's length), None all.
    """
    e = pairs.select("source", "target").where("source is not null and target is not null").distinct()
    e = written(e, "cycles")
    for _ in range(8):  # what no cycle can pass goes first: ends without a way in or out, again and again
        n = e.count()
        e = written(e.join(e.select(F.col("target").alias("source")), "source", "left_semi").join(e.select(F.col("source").alias("target")), "target", "left_semi").select("source", "target"), "cycles")
        if e.count() == n:
            break
    loops = e.where("source = target").select(F.array("source").alias("nodes"))
    chain = e.where("source < target").select(F.array("source", "target").alias("nodes"), F.col("target").alias("end"))
    out = loops
    for n in range(2, longest + 1):
        back = chain.join(e.withColumnRenamed("source", "end"), "end").where(F.col("target") == F.col("nodes")[0]).select("nodes")
        out = out.unionByName(back)
        if n < longest:
            ahead = chain.join(e.withColumnRenamed("source", "end"), "end").where((F.col("target") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("target")))
            chain = ahead.select(F.concat("nodes", F.array("target")).alias("nodes"), F.col("target").alias("end"))
    found = out.select(F.size("nodes").alias("length"), F.array_join("nodes", " > ").alias("nodes"))
    return found.orderBy("length", "nodes").limit(top) if top else found


def import_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """File-to-file pairs of import edges, oriented from the edge's own source file to the file of the other end."""
    file = nodes.select("id", F.col("source_file").alias("file"))
    e = edges.where(F.col("relation").isin("imports_from", "re_exports") & (F.coalesce("source_file", F.lit("")) != ""))
    e = e.join(file.select(F.col("id").alias("source"), F.col("file").alias("sf")), "source", "left").join(file.select(F.col("id").alias("target"), F.col("file").alias("tf")), "target", "left")
    other = F.when(F.col("sf") == F.col("source_file"), F.col("tf")).otherwise(F.col("sf"))
    return e.select(F.col("source_file").alias("source"), other.alias("target")).where("target is not null and target <> ''").distinct()
