"""Graphs from tables: nodes (id, label, file_type, source_file, community) and edges (source, target, key, relation, confidence,
confidence_score, weight, context, source_file), with the same text in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.materialize import ship

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "source string, target string, key string, relation string, confidence string, confidence_score double, weight double, context string, source_file string"

#: Supply graph: regions, nations, customers, suppliers and parts; line items are parallel supplier-part edges.
SQL = """
nodes AS (
  SELECT 'region:' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS label, 'concept' AS file_type, 'geo/region.csv' AS source_file, CAST(r_regionkey AS INT) AS community FROM region
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), n_name, 'concept', 'geo/nation.csv', CAST(n_regionkey AS INT) FROM nation
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), c_name, 'document', 'sales/customer.md', CAST(n_regionkey AS INT) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), s_name, 'code', 'supply/supplier.py', CAST(n_regionkey AS INT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || CAST(p_partkey AS VARCHAR), p_name, 'code', 'catalog/part.rs', CAST(p_size % 5 AS INT) FROM part),
edges AS (
  SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS source, 'region:' || CAST(n_regionkey AS VARCHAR) AS target, 'n' AS "key", 'in_region' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS confidence_score, CAST(1.0 AS DOUBLE) AS weight, 'geo' AS context, 'geo/nation.csv' AS source_file FROM nation
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR), 'c', 'lives_in', 'EXTRACTED', CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), 'geo', 'sales/customer.md' FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'nation:' || CAST(s_nationkey AS VARCHAR), 's', 'based_in', 'INFERRED', CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE), 'geo', 'supply/supplier.py' FROM supplier
  UNION ALL SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR), 'part:' || CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR),
    CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'uses' END, CASE l_linenumber % 3 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'EXTRACTED' ELSE 'INFERRED' END,
    CASE l_linenumber % 3 WHEN 0 THEN CAST(0.2 AS DOUBLE) WHEN 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, l_quantity, l_returnflag, 'supply/supplier.py' FROM lineitem)
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    ship(spark)
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation, customer, supplier, part, line = load(spark, sf_dir, "region", "nation", "customer", "supplier", "part", "lineitem")

    def named(kind: str, key: str):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    def node(df: DataFrame, kind: str, key: str, label: str, file_type: str, source: str, community) -> DataFrame:
        return df.select(named(kind, key).alias("id"), F.col(label).alias("label"), F.lit(file_type).alias("file_type"), F.lit(source).alias("source_file"), community.cast("int").alias("community"))

    geo = F.broadcast(nation.select("n_nationkey", "n_regionkey"))  # 25 nations at every scale
    nodes = (
        node(region, "region", "r_regionkey", "r_name", "concept", "geo/region.csv", F.col("r_regionkey"))
        .unionByName(node(nation, "nation", "n_nationkey", "n_name", "concept", "geo/nation.csv", F.col("n_regionkey")))
        .unionByName(node(customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "c_name", "document", "sales/customer.md", F.col("n_regionkey")))
        .unionByName(node(supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "s_name", "code", "supply/supplier.py", F.col("n_regionkey")))
        .unionByName(node(part, "part", "p_partkey", "p_name", "code", "catalog/part.rs", F.col("p_size") % 5))
    )

    def edge(df: DataFrame, a, b, key, relation, confidence, score, weight, context, source: str) -> DataFrame:
        return df.select(a.alias("source"), b.alias("target"), key.alias("key"), relation.alias("relation"), confidence.alias("confidence"), score.cast("double").alias("confidence_score"), weight.cast("double").alias("weight"), context.alias("context"), F.lit(source).alias("source_file"))

    one, third = F.lit(1.0), F.col("l_linenumber") % 3
    edges = (
        edge(nation, named("nation", "n_nationkey"), named("region", "n_regionkey"), F.lit("n"), F.lit("in_region"), F.lit("EXTRACTED"), one, one, F.lit("geo"), "geo/nation.csv")
        .unionByName(edge(customer, named("customer", "c_custkey"), named("nation", "c_nationkey"), F.lit("c"), F.lit("lives_in"), F.lit("EXTRACTED"), one, one, F.lit("geo"), "sales/customer.md"))
        .unionByName(edge(supplier, named("supplier", "s_suppkey"), named("nation", "s_nationkey"), F.lit("s"), F.lit("based_in"), F.lit("INFERRED"), F.lit(0.5), one, F.lit("geo"), "supply/supplier.py"))
        .unionByName(
            edge(
                line, named("supplier", "l_suppkey"), named("part", "l_partkey"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
                F.when(F.col("l_linenumber") % 2 == 0, "calls").otherwise("uses"), F.when(third == 0, "AMBIGUOUS").when(third == 1, "EXTRACTED").otherwise("INFERRED"),
                F.when(third == 0, 0.2).when(third == 1, 1.0).otherwise(0.5), F.col("l_quantity"), F.col("l_returnflag"), "supply/supplier.py",
            )
        )
    )
    return nodes, edges


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and hyperedges of a node-link JSON document (``links`` or ``edges``; ``from``/``to`` are taken too).

    Attributes beyond the core ones are kept as JSON in ``attrs``.
    """
    doc = spark.read.text(path, wholetext=True)
    item = "array<map<string,string>>"
    both = doc.select(F.from_json("value", f"nodes {item}, links {item}, edges {item}, hyperedges {item}, graph map<string,string>").alias("d"))
    n = both.select(F.explode("d.nodes").alias("m"))
    core = ["id", "label", "file_type", "source_file", "source_location", "community"]
    nodes = n.select(*(F.col("m")[c].alias(c) for c in core), F.map_filter("m", lambda k, v: ~k.isin(*core)).alias("attrs")).withColumn("community", F.col("community").cast("int"))
    e = both.select(F.explode(F.coalesce("d.links", "d.edges")).alias("m"))
    known = ["key", "relation", "confidence", "confidence_score", "weight", "context", "source_file", "source_location"]
    ends = ["source", "target", "from", "to", "_src", "_tgt"]
    m = F.col("m")
    edges = e.select(F.coalesce(m["_src"], m["source"], m["from"]).alias("source"), F.coalesce(m["_tgt"], m["target"], m["to"]).alias("target"), *(m[c].alias(c) for c in known), F.map_filter("m", lambda k, v: ~k.isin(*known, *ends)).alias("attrs"))
    edges = edges.withColumn("confidence_score", F.col("confidence_score").cast("double")).withColumn("weight", F.col("weight").cast("double"))
    h = both.select(F.explode(F.coalesce("d.hyperedges", F.from_json(F.col("d.graph")["hyperedges"], item))).alias("m"))
    hyper = h.select(m["id"].alias("id"), m["label"].alias("label"), F.from_json(F.coalesce(m["nodes"], m["members"], m["node_ids"]), "array<string>").alias("nodes"), m["relation"].alias("relation"), m["confidence"].alias("confidence"))
    return nodes, edges, hyper


def graph_class(directed: bool | None, multigraph: bool | None, declared: str | None = None) -> str:
    """simple, digraph or multidigraph from the flags; a declared class must agree, and undirected multigraphs are refused."""
    if multigraph and not directed:
        raise ValueError("an undirected multigraph is not a graph class")
    found = "multidigraph" if multigraph else "digraph" if directed else "simple"
    if declared and declared != found and (directed is not None or multigraph is not None):
        raise ValueError(f"declared class {declared} contradicts the flags ({found})")
    return declared or found
