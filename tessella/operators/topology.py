"""Topology: degrees, projections of parallel edges, envelopes, statistics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name
from tessella.functions.text import confidence_score
from tessella.plans.materialize import width, written

NOISE = "Any AsyncMock Callable ClassVar Counter Dict Enum False Final List Literal MagicMock Mock NonCallableMagicMock NonCallableMock Optional OrderedDict Path PropertyMock Protocol Set True Tuple Type Union abc bool bytearray bytes complex datetime defaultdict float int io json object os patch re sentinel str sys typing".split()
JSON_KEYS = "bundleddependencies bundledependencies data dependencies description devdependencies end id items key name optionaldependencies peerdependencies properties start title type value version".split()


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge from either end: a, b and further columns."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), *more)
    return out.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), *more))


def distinct_degree(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """id and degree: distinct neighbours over both directions; a self-loop counts the node itself, an isolate 0.

    Pairs are made distinct before counting, so a hub is counted from partial results. ``pairs``: those pairs, if they are there already.
    """
    n = (both_ways(edges).distinct() if pairs is None else pairs).groupBy("a").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, nodes.id == n.a, "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def record_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and degree by edge records: parallels count each, a self-loop twice."""
    n = both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, nodes.id == n.a, "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def is_concept(source_file: Column) -> Column:
    s = F.coalesce(source_file, F.lit(""))
    return (s == "") | ~base_name(s).contains(".")


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, a method stub, or a function stub with at most one neighbour."""
    x, s = F.coalesce(label, F.lit("")), F.coalesce(source_file, F.lit(""))
    return (x != "") & (((s != "") & (x == base_name(s))) | (x.startswith(".") & x.endswith("()")) | (x.endswith("()") & (degree <= 1)))


def is_json_key(label: Column, source_file: Column) -> Column:
    return F.lower(F.coalesce(source_file, F.lit(""))).endswith(".json") & F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*JSON_KEYS)


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The most connected real entities: id, label, degree; file, concept, JSON-key and builtin nodes are left out after ranking."""
    n = nodes.join(distinct_degree(nodes, edges), "id")
    label, source = F.col("label"), F.col("source_file")
    real = n.where(~is_file_node(label, source, F.col("degree")) & ~is_concept(source) & ~is_json_key(label, source) & ~F.coalesce(label, F.lit("")).isin(*NOISE))
    return real.select("id", F.coalesce("label", "id").alias("label"), "degree").orderBy(F.desc("degree"), "id").limit(top)


def record_order() -> list[Column]:
    """The order of parallel records: by falling score, then by text."""
    return [(-confidence_score(F.col("confidence_score"), F.col("confidence"))).alias("s"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("relation", "source_file", "context", "key"))]


def project(edges: DataFrame, mode: str = "confidence") -> DataFrame:
    """Simple undirected edges a < b: weight (largest score, count, or sum of scores), parallel_edge_count, representative relation and confidence."""
    if mode not in ("confidence", "count", "sum"):
        raise ValueError("mode is confidence, count or sum")
    score = confidence_score(F.col("confidence_score"), F.col("confidence"))
    weight = {"confidence": F.max(score), "count": F.count("*").cast("double"), "sum": F.sum(score)}[mode]
    first = F.min(F.struct(*record_order(), "confidence"))
    out = edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(weight.alias("weight"), F.count("*").alias("parallel_edge_count"), first.alias("r"))
    return out.select("a", "b", "weight", "parallel_edge_count", "r.relation", "r.confidence")


def call_flow(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Simple directed edges of the given relations, no loops: weight is the largest score."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    score = confidence_score(F.col("confidence_score"), F.col("confidence"))
    out = e.where("source <> target").groupBy("source", "target").agg(F.max(score).alias("weight"), F.count("*").alias("parallel_edge_count"), F.min(F.struct(*record_order(), "confidence")).alias("r"))
    return out.select("source", "target", "weight", "parallel_edge_count", "r.relation", "r.confidence")


def context_edges(edges: DataFrame, contexts: list[str] | None) -> DataFrame:
    wanted = sorted({c.strip().lower() for c in contexts or [] if c.strip()})
    return edges.where(F.lower(F.trim(F.coalesce("context", F.lit("")))).isin(*wanted)) if wanted else edges


def pair_summary(edges: DataFrame) -> DataFrame:
    """Per unordered pair: count and the sorted distinct relations and confidences."""
    g = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return g.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("relation")).alias("relations"), F.array_sort(F.collect_set("confidence")).alias("confidences"))


def envelopes(edges: DataFrame, cap: int = 3, directed: bool = False) -> DataFrame:
    """Per pair: total count, the first ``cap`` records in record order, how many are left out, all relations and confidences.

    The cap is applied by a window that the planner turns into a map-side group limit, so no group is gathered whole.
    """
    from pyspark.sql import Window

    cap = max(cap, 0)
    a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    e = edges.select(a.alias("a"), b.alias("b"), "relation", "confidence", "confidence_score", "source_file", "context", "key")
    total = e.groupBy("a", "b").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("relation")).alias("relations"), F.array_sort(F.collect_set("confidence")).alias("confidences"))
    order = Window.partitionBy("a", "b").orderBy(*record_order())
    top = e.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("r", "relation", "confidence", "key"))).alias("t"))
    shown = F.transform(F.coalesce("t", F.array()), lambda x: F.concat_ws(":", x["relation"], x["confidence"], x["key"]))
    return total.join(top, ["a", "b"], "left").select("a", "b", "count", F.array_join(shown, "|").alias("shown"), F.greatest(F.lit(0), F.col("count") - cap).alias("truncated"), "relations", "confidences")


def envelope_text(edges: DataFrame, cap: int = 3) -> DataFrame:
    """One line a pair: the first records, how many more, and the total."""
    e = envelopes(edges, cap)
    names = F.array_join(F.slice("relations", 1, cap if cap > 0 else 1), ", ")
    return e.select("a", "b", F.when(F.col("count") == 1, names).otherwise(F.concat(names, F.when(F.col("truncated") > 0, F.concat(F.lit(", +"), F.col("truncated").cast("string"), F.lit(" more"))).otherwise(""), F.lit(" ("), F.col("count").cast("string"), F.lit(" total)"))).alias("text"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, and the rounded percentage of each confidence."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    parts = {c: F.bround(100.0 * F.count(F.when(F.col("confidence") == c, 1)) / F.greatest(F.count("*"), F.lit(1)), 0).cast("int").alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")}
    return n.join(edges.agg(F.count("*").alias("edges"), *parts.values()))  # one row and one row


def collapse_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters: what a simple graph class would lose of these edges."""
    gone = missing_ends(nodes, edges)
    ends = edges.select("source", "target", F.lit(True).alias("_"))
    for c in ("source", "target"):
        ends = ends.join(gone.select(F.col("id").alias(c), F.lit(True).alias(f"no_{c}")), c, "left")
    lost = F.col("source").isNull() | F.col("target").isNull() | F.col("no_source") | F.col("no_target")
    total = ends.agg(F.count("*").alias("edges"), F.count(F.when(lost, 1)).alias("dangling"), F.count(F.when(F.col("source") == F.col("target"), 1)).alias("self_loops"))
    # one shuffle by unordered pair serves both: directed groups lie within one
    way = F.when(F.col("source").isNull(), 2).when(F.col("target").isNull(), 3).when(F.col("source") <= F.col("target"), 0).otherwise(1)
    kinds = ("relation", "confidence", "context")
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), way.alias("way"), *kinds).repartition(width(edges.sparkSession), "a", "b")
    each = pairs.groupBy("a", "b", "way").agg(F.count("*").alias("n"), *((F.min(c) < F.max(c)).alias(c) for c in kinds))
    loose = each.groupBy("a", "b").agg(F.sum("n").alias("all"), F.count("*").alias("ways"), F.count(F.when(F.col("n") > 1, 1)).alias("parallel"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in kinds), F.max("n").alias("most"))
    groups = loose.agg(
        F.coalesce(F.sum("ways"), F.lit(0)).alias("directed_pairs"), F.sum(F.col("all") - F.col("ways")).alias("directed_collapse"), F.coalesce(F.sum("parallel"), F.lit(0)).alias("parallel_groups"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_groups") for c in kinds), F.max("most").alias("largest_group"), F.count("*").alias("undirected_pairs"), F.sum(F.col("all") - 1).alias("undirected_collapse"),
    )
    return total.join(groups)  # single rows


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of every end that no node has, once; written, so that few of them are broadcast and the edges stay where they are."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct()
    return written(ends.join(nodes.select("id"), "id", "left_anti"), "missing")


def neighbours(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """direction, other end, relation, confidence of every edge at a node."""
    e = edges if relation is None else edges.where(F.lower("relation").contains(relation.lower()))
    out = e.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "relation", "confidence")
    return out.unionByName(e.where((F.col("target") == node) & (F.col("source") != node)).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "relation", "confidence"))


def dominant_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the most frequent confidence at it (ties: the smaller name; none: EXTRACTED)."""
    n = both_ways(edges, "confidence").groupBy("a", "confidence").agg(F.count("*").alias("n"))
    top = n.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "confidence")).alias("t"))
    return nodes.select("id").join(top, nodes.id == top.a, "left").select("id", F.coalesce("t.confidence", F.lit("EXTRACTED")).alias("confidence"))
