"""Registered queries of the graph and text operators over the star-schema tables, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators import community, feedback, impact, merge, prepare, rank, sections, topology, traverse
from tessella.plans.materialize import width
from tessella.sources.graphs import SQL, load, supply_graph
from tessella.sources.sinks import cypher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False):
    """Registers a query; ``graph`` puts the graph's tables before its SQL."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH RECURSIVE {SQL}{sql}" if graph else sql
        return f

    return keep


DEGREE = """, two AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges), degree AS (SELECT id, COUNT(b) AS degree FROM nodes LEFT JOIN two ON id = a GROUP BY id)"""
SCORE = "COALESCE(confidence_score, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 0.0 END)"

# --- topology


@query(DEGREE + " SELECT id, label, degree FROM nodes JOIN degree USING (id) WHERE label <> regexp_extract(source_file, '[^/]+$') ORDER BY degree DESC, id LIMIT 10", True)
def god_nodes(spark, d):
    return topology.god_nodes(*supply_graph(spark, d))


@query(DEGREE + " SELECT id, degree FROM degree", True)
def degree_distinct(spark, d):
    return topology.distinct_degree(*supply_graph(spark, d))


@query(", two AS (SELECT source a FROM edges UNION ALL SELECT target FROM edges) SELECT id, COUNT(a) AS degree FROM nodes LEFT JOIN two ON id = a GROUP BY id", True)
def degree_records(spark, d):
    return topology.record_degree(*supply_graph(spark, d))


def _project(mode: str, weight: str) -> None:
    def f(spark, d):
        return topology.project(supply_graph(spark, d)[1], mode).select("a", "b", F.round("weight", 6).alias("weight"), "parallel_edge_count")

    f.__name__ = f"project_{mode}"
    query(f" SELECT LEAST(source, target) AS a, GREATEST(source, target) AS b, ROUND({weight}, 6) AS weight, COUNT(*) AS parallel_edge_count FROM edges WHERE source <> target GROUP BY 1, 2", True)(f)


_project("confidence", f"MAX({SCORE})")
_project("count", "CAST(COUNT(*) AS DOUBLE)")
_project("sum", f"SUM({SCORE})")


@query(f" SELECT source, target, MAX({SCORE}) AS weight, COUNT(*) AS parallel_edge_count FROM edges WHERE relation = 'calls' AND source <> target GROUP BY 1, 2", True)
def call_flow(spark, d):
    return topology.call_flow(supply_graph(spark, d)[1], ["calls"]).select("source", "target", "weight", "parallel_edge_count")


@query(" SELECT LEAST(source, target) AS a, GREATEST(source, target) AS b, COUNT(*) AS count, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations, array_to_string(list_sort(list(DISTINCT confidence)), ',') AS confidences FROM edges GROUP BY 1, 2", True)
def pair_summary(spark, d):
    s = topology.pair_summary(supply_graph(spark, d)[1])
    return s.select("a", "b", "count", F.array_join("relations", ",").alias("relations"), F.array_join("confidences", ",").alias("confidences"))


@query(f""", r AS (SELECT LEAST(source, target) AS a, GREATEST(source, target) AS b, relation || ':' || confidence || ':' || "key" AS t, ROW_NUMBER() OVER (PARTITION BY LEAST(source, target), GREATEST(source, target) ORDER BY -{SCORE}, relation, source_file, context, "key") AS n, COUNT(*) OVER (PARTITION BY LEAST(source, target), GREATEST(source, target)) AS c FROM edges)
SELECT a, b, MAX(c) AS count, string_agg(t, '|' ORDER BY n) AS shown, GREATEST(0, MAX(c) - 3) AS truncated FROM r WHERE n <= 3 GROUP BY a, b""", True)
def envelope_top3(spark, d):
    return topology.envelopes(supply_graph(spark, d)[1], 3).select("a", "b", "count", "shown", "truncated")


@query(" SELECT source, target, \"key\" FROM edges WHERE LOWER(TRIM(context)) IN ('r', 'geo')", True)
def context_edges(spark, d):
    return topology.context_edges(supply_graph(spark, d)[1], ["R ", "geo"]).select("source", "target", "key")


@query(" SELECT (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(DISTINCT community) FROM nodes) AS communities, COUNT(*) AS edges, " + ", ".join(f"CAST(round_even(100.0 * COUNT(*) FILTER (confidence = '{c}') / COUNT(*), 0) AS INT) AS {c.lower()}" for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")) + " FROM edges", True)
def confidence_mix(spark, d):
    return topology.graph_stats(*supply_graph(spark, d))


@query(""", g AS (SELECT source, target, COUNT(*) n, COUNT(DISTINCT relation) r, COUNT(DISTINCT confidence) c, COUNT(DISTINCT context) x FROM edges GROUP BY 1, 2), u AS (SELECT COUNT(*) n FROM edges GROUP BY LEAST(source, target), GREATEST(source, target))
SELECT (SELECT COUNT(*) FROM edges) AS edges, (SELECT COUNT(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)) AS dangling, (SELECT COUNT(*) FROM edges WHERE source = target) AS self_loops, COUNT(*) AS directed_pairs, CAST(SUM(n - 1) AS BIGINT) AS directed_collapse, COUNT(*) FILTER (n > 1) AS parallel_groups, COUNT(*) FILTER (r > 1) AS relation_groups, COUNT(*) FILTER (c > 1) AS confidence_groups, COUNT(*) FILTER (x > 1) AS context_groups, MAX(n) AS largest_group, (SELECT COUNT(*) FROM u) AS undirected_pairs, (SELECT CAST(SUM(n - 1) AS BIGINT) FROM u) AS undirected_collapse FROM g""", True)
def collapse_diagnostics(spark, d):
    return topology.collapse_risk(*supply_graph(spark, d))


@query(""", two AS (SELECT source a, confidence FROM edges UNION ALL SELECT target, confidence FROM edges), n AS (SELECT a, confidence, ROW_NUMBER() OVER (PARTITION BY a ORDER BY COUNT(*) DESC, confidence) r FROM two GROUP BY 1, 2)
SELECT id, COALESCE(confidence, 'EXTRACTED') AS confidence FROM nodes LEFT JOIN n ON id = a AND r = 1""", True)
def dominant_confidence(spark, d):
    return topology.dominant_confidence(*supply_graph(spark, d))


@query(" SELECT 'out' AS direction, target AS other, relation, confidence FROM edges WHERE source = 'nation:3' UNION ALL SELECT 'in', source, relation, confidence FROM edges WHERE target = 'nation:3'", True)
def neighbours(spark, d):
    return topology.neighbours(supply_graph(spark, d)[1], "nation:3")


# --- traversal

_LEVEL = """, e{n} AS MATERIALIZED (SELECT a source, b target FROM near SEMI JOIN (SELECT id FROM l{p}{open}) f ON near.a = f.id ANTI JOIN v{p} ON near.b = v{p}.id), l{n} AS MATERIALIZED (SELECT DISTINCT target id FROM e{n}), v{n} AS MATERIALIZED (SELECT id FROM v{p} UNION SELECT id FROM l{n})"""
BFS = DEGREE.replace(" AS (", " AS MATERIALIZED (") + """, near AS MATERIALIZED (SELECT DISTINCT a, b FROM two WHERE a <> b), gate AS MATERIALIZED (SELECT GREATEST(50, MIN(degree)) g FROM (SELECT degree, ROW_NUMBER() OVER (ORDER BY degree) - 1 r, COUNT(*) OVER () n FROM degree) WHERE r >= CAST(FLOOR(0.99 * n) AS BIGINT)),
hub AS MATERIALIZED (SELECT id FROM degree, gate WHERE degree >= g), l0 AS MATERIALIZED (SELECT 'nation:3' AS id), v0 AS MATERIALIZED (SELECT id FROM l0)""" + "".join(_LEVEL.format(n=n, p=n - 1, open="" if n == 1 else " EXCEPT SELECT id FROM hub") for n in (1, 2, 3))


def _seed(spark, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(BFS + " SELECT id, 0 AS level FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3", True)
def bfs_layers(spark, d):
    return traverse.expand(*supply_graph(spark, d), _seed(spark, "nation:3"), 3)[0]


@query(BFS + " SELECT 1 AS level, source, target FROM e1 UNION ALL SELECT 2, source, target FROM e2 UNION ALL SELECT 3, source, target FROM e3", True)
def bfs_edges(spark, d):
    return traverse.expand(*supply_graph(spark, d), _seed(spark, "nation:3"), 3)[1].select("level", "source", "target")


@query(""", e AS (SELECT source, target, relation FROM edges WHERE relation IN ('calls', 'uses')), s1 AS (SELECT source id, MIN(relation) relation FROM e WHERE target = 'part:1' AND source <> 'part:1' GROUP BY 1)
SELECT id, 1 AS depth, relation FROM s1 UNION ALL SELECT source, 2, MIN(e.relation) FROM e JOIN s1 ON target = id WHERE source NOT IN (SELECT id FROM s1) AND source <> 'part:1' GROUP BY 1""", True)
def affected_depth2(spark, d):
    return traverse.affected(supply_graph(spark, d)[1], "part:1")


@query(""", near AS (SELECT DISTINCT a, b FROM (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges) WHERE a <> b),
p1 AS (SELECT b AS c, 'customer:1,' || b AS p FROM near WHERE a = 'customer:1'), p2 AS (SELECT b AS c, MIN(p || ',' || b) AS p FROM p1 JOIN near ON a = c GROUP BY 1), p3 AS (SELECT b AS c, MIN(p || ',' || b) AS p FROM p2 JOIN near ON a = c GROUP BY 1), p4 AS (SELECT b AS c, MIN(p || ',' || b) AS p FROM p3 JOIN near ON a = c GROUP BY 1), p5 AS (SELECT b AS c, MIN(p || ',' || b) AS p FROM p4 JOIN near ON a = c GROUP BY 1),
hit AS (SELECT p FROM (SELECT 1 n, c, p FROM p1 UNION ALL SELECT 2, c, p FROM p2 UNION ALL SELECT 3, c, p FROM p3 UNION ALL SELECT 4, c, p FROM p4 UNION ALL SELECT 5, c, p FROM p5) WHERE c = 'part:5' ORDER BY n LIMIT 1)
SELECT CAST(UNNEST(range(len(string_split(p, ',')))) AS INT) AS hop, UNNEST(string_split(p, ',')) AS id FROM hit""", True)
def shortest_path(spark, d):
    return traverse.shortest_path(supply_graph(spark, d)[1], "customer:1", "part:5")


TRADE = "SELECT DISTINCT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS source, 'n' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


def _trade(spark, d) -> DataFrame:
    """Who buys from whom: nations of the customers and of the suppliers of every line item."""
    line, orders, customer, supplier = load(spark, d, "lineitem", "orders", "customer", "supplier")
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0"))
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(name("c_nationkey").alias("source"), name("s_nationkey").alias("target"))


_CYCLES = f"""WITH e AS MATERIALIZED ({TRADE}), c2 AS (SELECT source s, target t, [source, target] AS p FROM e WHERE source < target)""" + "".join(f", c{n} AS (SELECT s, target t, list_append(p, target) AS p FROM c{n - 1} JOIN e ON t = source WHERE target > s AND NOT list_contains(p, target))" for n in (3, 4, 5)) + ", found AS (SELECT 1 AS length, source AS nodes FROM e WHERE source = target" + "".join(f" UNION ALL SELECT {n}, array_to_string(p, ' > ') FROM c{n} JOIN e ON t = source AND target = s" for n in (2, 3, 4, 5)) + ")"


@query(_CYCLES + " SELECT length, COUNT(*) AS n, MIN(nodes) AS first, MAX(nodes) AS last FROM found GROUP BY length")
def cycles_by_length(spark, d):
    """Every cycle of up to five nations, counted: the graph is nearly complete, so there are over a million."""
    return traverse.cycles(_trade(spark, d), 5, None).groupBy("length").agg(F.count("*").alias("n"), F.min("nodes").alias("first"), F.max("nodes").alias("last"))


@query(_CYCLES + " SELECT length, nodes FROM found ORDER BY length, nodes LIMIT 20")
def cycles_top20(spark, d):
    return traverse.cycles(_trade(spark, d))


CC = "SELECT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'p' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders"


@query(f"""WITH two AS MATERIALIZED (SELECT a, b FROM ({CC}) UNION SELECT b, a FROM ({CC})), r0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS c FROM two)""" + "".join(f", r{n} AS MATERIALIZED (SELECT node, LEAST(MIN(r.c), MIN(o.c)) AS c FROM r{n - 1} r JOIN two ON r.node = two.a JOIN (SELECT node AS other, c FROM r{n - 1}) o ON o.other = two.b GROUP BY node)" for n in range(1, 9)) + " SELECT node, c AS component FROM r8")
def components(spark, d):
    """Suppliers and parts of every line item, and customers and orders of every order. The SQL passes the least label on eight times."""
    from tessella.operators.components import connected_components

    line, orders = load(spark, d, "lineitem", "orders")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return connected_components(line.select(name("s", "l_suppkey").alias("a"), name("p", "l_partkey").alias("b")).union(orders.select(name("c", "o_custkey"), name("o", "o_orderkey"))))


# --- ranking

TERM = "a"


def _terms(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    return (*supply_graph(spark, d), ["supplier", "customer"])


SCORES = """, t AS (SELECT id, label, LOWER(label) AS norm, regexp_replace(LOWER(label), '[^a-z0-9_]+', ' ', 'g') AS toks, LOWER(source_file) AS src FROM nodes),
i AS (SELECT LN(1 + COUNT(*) / CAST(1 + COUNT(*) FILTER (contains(norm, 'supplier')) AS DOUBLE)) AS s, LN(1 + COUNT(*) / CAST(1 + COUNT(*) FILTER (contains(norm, 'customer')) AS DOUBLE)) AS c FROM t),
scored AS (SELECT id, label, CASE WHEN norm = 'supplier' THEN 1000 * s WHEN starts_with(norm, 'supplier') THEN 100 * s WHEN contains(norm, 'supplier') THEN s ELSE 0 END + CASE WHEN contains(src, 'supplier') THEN 0.5 * s ELSE 0 END
 + CASE WHEN norm = 'customer' THEN 1000 * c WHEN starts_with(norm, 'customer') THEN 100 * c WHEN contains(norm, 'customer') THEN c ELSE 0 END + CASE WHEN contains(src, 'customer') THEN 0.5 * c ELSE 0 END AS score FROM t, i)"""


@query(SCORES + " SELECT id, label, ROUND(score, 6) AS score FROM scored WHERE score > 0", True)
def node_scores(spark, d):
    n, _, terms = _terms(spark, d)
    return rank.score_nodes(n, terms).select("id", "label", F.round("score", 6).alias("score"))


@query(SCORES + ", top AS (SELECT id, score FROM scored WHERE score > 0 ORDER BY ROUND(score, 9) DESC, length(label), id LIMIT 3) SELECT id FROM top WHERE score >= 0.2 * (SELECT MAX(score) FROM top)", True)
def seeds(spark, d):
    n, _, terms = _terms(spark, d)
    return rank.seeds(rank.score_nodes(n, terms).withColumn("score", F.round("score", 9))).select("id")


@query(" SELECT id, label, CASE WHEN id = 'asia' OR label = 'asia' THEN 0 WHEN LOWER(source_file) = 'asia' THEN 1 WHEN LOWER(label) = 'asia' THEN 2 WHEN starts_with(LOWER(label), 'asia') THEN 3 ELSE 4 END AS tier FROM nodes WHERE contains(LOWER(label), 'asia')", True)
def find_node(spark, d):
    return rank.find_node(supply_graph(spark, d)[0], "asia")


SURPRISE = DEGREE + f""", s AS (SELECT e.source, e.target, e.relation, e.confidence, e."key", u.community <> v.community AS far, du.degree a, dv.degree b, e.relation IN ('calls', 'uses') AND e.confidence = 'INFERRED' AND u.source_file LIKE '%.py' AND v.source_file LIKE '%.rs' AS quiet, (u.source_file LIKE '%.csv' OR u.source_file LIKE '%.md') <> (v.source_file LIKE '%.csv' OR v.source_file LIKE '%.md') AS kinds, split_part(u.source_file, '/', 1) <> split_part(v.source_file, '/', 1) AS dirs
 FROM edges e JOIN nodes u ON e.source = u.id JOIN nodes v ON e.target = v.id JOIN degree du ON du.id = u.id JOIN degree dv ON dv.id = v.id WHERE u.source_file <> v.source_file)
SELECT source, target, relation, confidence, "key", CASE WHEN quiet THEN 0 ELSE CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + 2 * CAST(kinds AS INT) + 2 * CAST(dirs AS INT) + CAST(far AS INT) END + CAST(LEAST(a, b) <= 2 AND GREATEST(a, b) >= 5 AS INT) AS score FROM s"""


@query(SURPRISE, True)
def surprise_scores(spark, d):
    return rank.surprises(*supply_graph(spark, d), top=None)


@query(SURPRISE + ' ORDER BY score DESC, source, target, relation, confidence, "key" LIMIT 5', True)
def surprises(spark, d):
    return rank.surprises(*supply_graph(spark, d))


@query(""", j AS (SELECT LEAST(u.community, v.community) ca, GREATEST(u.community, v.community) cb, e.*, CASE e.confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END k FROM edges e JOIN nodes u ON e.source = u.id JOIN nodes v ON e.target = v.id WHERE u.community <> v.community)
SELECT ca, cb, source, target, relation, confidence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ca, cb ORDER BY k, source, target, relation, "key") r FROM j) WHERE r = 1""", True)
def cross_community_rep(spark, d):
    return rank.cross_community(*supply_graph(spark, d))


@query()
def answer_question(spark, d):
    return rank.answer(*supply_graph(spark, d), "which supplier is based in Kenya?", depth=2)


@query()
def suggested_questions(spark, d):
    return rank.questions(*supply_graph(spark, d))


# --- communities


@query(""", p AS (SELECT DISTINCT LEAST(source, target) a, GREATEST(source, target) b FROM edges WHERE source <> target), i AS (SELECT u.community c, COUNT(*) e FROM p JOIN nodes u ON a = u.id JOIN nodes v ON b = v.id WHERE u.community = v.community GROUP BY 1), s AS (SELECT community, COUNT(*) AS size FROM nodes GROUP BY 1)
SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE ROUND(COALESCE(e, 0) / (size * (size - 1) / 2.0), 12) END AS cohesion FROM s LEFT JOIN i ON community = c""", True)
def cohesion(spark, d):
    return community.cohesion(*supply_graph(spark, d)).withColumn("cohesion", F.round("cohesion", 12))


@query(""", two AS (SELECT source a FROM edges UNION ALL SELECT target FROM edges), g AS (SELECT id, label, community, COUNT(a) n FROM nodes LEFT JOIN two ON id = a GROUP BY 1, 2, 3)
SELECT community, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY community ORDER BY n DESC, id) r FROM g) WHERE r = 1""", True)
def hub_labels(spark, d):
    return community.hub_labels(*supply_graph(spark, d))


@query(""", two AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges)
SELECT u.id, COUNT(DISTINCT CASE WHEN v.community <> u.community THEN v.community END) AS reach FROM nodes u LEFT JOIN two ON a = u.id LEFT JOIN nodes v ON b = v.id GROUP BY 1""", True)
def community_reach(spark, d):
    return community.reach(*supply_graph(spark, d))


@query(""", j AS (SELECT u.community a, v.community b FROM edges JOIN nodes u ON source = u.id JOIN nodes v ON target = v.id WHERE u.community <> v.community)
SELECT community, other, COUNT(*) AS links FROM (SELECT a AS community, b AS other FROM j UNION ALL SELECT b, a FROM j) GROUP BY 1, 2""", True)
def cross_community_counts(spark, d):
    return community.cross_counts(*supply_graph(spark, d))


@query()
def detected_communities(spark, d):
    return community.communities(*supply_graph(spark, d))


@query()
def label_communities(spark, d):
    return community.communities(*supply_graph(spark, d), method="labels")


GEO = "SELECT id FROM nodes WHERE file_type = 'concept'"


@query(f""", g AS ({GEO}), t AS (SELECT e.source, e.target FROM edges e WHERE relation = 'in_region'), k AS (SELECT target, COUNT(*) n, (SELECT COUNT(*) FROM t x WHERE x.target = t.target) FROM t GROUP BY target)
SELECT id, CAST(COALESCE(n * (n - 1) / 2.0, 0) AS DOUBLE) AS score FROM g LEFT JOIN k ON id = target""", True)
def nation_betweenness(spark, d):
    """Nations around their regions are stars, so the middle of n leaves lies on n (n - 1) / 2 paths."""
    n, e = supply_graph(spark, d)
    return community.betweenness(n.where("file_type = 'concept'"), e)[0].withColumn("score", F.round("score", 6))


# --- merge

VERSIONS = "SELECT 'o' || CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS label, o_orderstatus AS source_file, o_orderkey AS pos FROM orders"


def _versions(spark, d) -> DataFrame:
    return load(spark, d, "orders")[0].select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("source_file"), F.col("o_orderkey").alias("pos"))


@query(f"WITH v AS ({VERSIONS}) SELECT id, arg_max(label, pos) AS label, arg_max(source_file, pos) AS source_file, MIN(pos) AS pos FROM v GROUP BY id")
def dedupe_nodes_last(spark, d):
    return merge.last_nodes(_versions(spark, d))


@query("WITH v AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) SELECT source, target, relation, MIN(pos) AS pos FROM v GROUP BY 1, 2, 3")
def dedupe_edges_first(spark, d):
    line = load(spark, d, "lineitem")[0].select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return merge.first_edges(line)


HALF = "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"


@query(f"""WITH o AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE {HALF}), n AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE NOT ({HALF})),
a AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) || ' | ' || o_orderpriority || ' | ordered | ' AS id FROM orders WHERE {HALF}), b AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) || ' | ' || o_orderpriority || ' | ordered | ' AS id FROM orders WHERE NOT ({HALF}))
SELECT 'added' AS change, 'node' AS kind, id AS identity FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', 'node', id FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'added', 'edge', id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', 'edge', id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def graph_diff(spark, d):
    o = load(spark, d, "orders")[0]
    side = lambda df: (df.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")), df.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("target"), F.lit("ordered").alias("relation"), F.lit("").alias("key")))
    return merge.graph_diff(*side(o.where("o_orderdate < timestamp'1996-01-01'")), *side(o.where("not (o_orderdate < timestamp'1996-01-01')")))


@query(f"WITH v AS ({VERSIONS}), n AS (SELECT * FROM v WHERE pos % 7 = 0 AND source_file = 'F') SELECT id, label, source_file, pos FROM v WHERE source_file NOT IN ('F', 'P') UNION ALL SELECT id, label, source_file, pos FROM n")
def incremental_replace(spark, d):
    v = _versions(spark, d)
    gone = spark.createDataFrame([("P",)], "source_file string")
    return merge.replace_sources(v, v.where("pos % 7 = 0 and source_file = 'F'"), gone)


@query(" SELECT id, label FROM nodes WHERE id NOT LIKE 'region:%'", True)
def prune_nodes(spark, d):
    n, e = supply_graph(spark, d)
    return merge.prune(n, e, n.where("id like 'region:%'").select("id"))[0].select("id", "label")


@query(" SELECT source, target, \"key\" FROM edges WHERE source NOT LIKE 'nation:%' AND target NOT LIKE 'nation:%'", True)
def prune_dangling_edges(spark, d):
    n, e = supply_graph(spark, d)
    return merge.live_edges(n.where("id not like 'nation:%'"), e).select("source", "target", "key")


@query(" SELECT 'dangling target' AS rule, target AS subject FROM edges WHERE target LIKE 'region:%'", True)
def validate_graph(spark, d):
    n, e = supply_graph(spark, d)
    return merge.violations(n.where("id not like 'region:%'"), e)


@query("SELECT 'h' || CAST(l_orderkey AS VARCHAR) AS id, 'order' AS relation, array_to_string(list_sort(list(DISTINCT 'p' || CAST(l_partkey AS VARCHAR))), ',') AS nodes FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_orderkey HAVING COUNT(DISTINCT l_partkey) >= 2")
def hyperedge_reconcile(spark, d):
    line, part = load(spark, d, "lineitem", "part")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    rec = line.groupBy("l_orderkey").agg(F.collect_list(name("l_partkey")).alias("nodes")).select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("o").alias("label"), F.lit("order").alias("relation"), "nodes")
    live = part.where("p_partkey % 3 <> 0").select(name("p_partkey").alias("id"))
    return merge.hyperedges(rec, live).select("id", "relation", F.array_join("nodes", ",").alias("nodes"))


THREE = """WITH b AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier), c AS (SELECT id, CASE WHEN id % 5 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN id % 7 = 0 THEN 99 ELSE nation END AS nation FROM b WHERE id % 11 <> 0), o AS (SELECT id, CASE WHEN id % 6 = 0 THEN name || '?' ELSE name END AS name, nation FROM b WHERE id % 13 <> 0),
j AS (SELECT b.id, b.name bn, c.name cn, o.name onm, b.nation ba, c.nation ca, o.nation oa, c.id IS NOT NULL hc, o.id IS NOT NULL ho, c.name = b.name AND c.nation = b.nation sc, o.name = b.name AND o.nation = b.nation so FROM b LEFT JOIN c USING (id) LEFT JOIN o USING (id))"""


def _three(spark, d):
    b = load(spark, d, "supplier")[0].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    c = b.where("id % 11 <> 0").withColumn("name", F.expr("if(id % 5 = 0, name || '!', name)")).withColumn("nation", F.expr("if(id % 7 = 0, 99, nation)"))
    o = b.where("id % 13 <> 0").withColumn("name", F.expr("if(id % 6 = 0, name || '?', name)"))
    return merge.three_way(b, c, o, ["id"], ["name", "nation"])


@query(THREE + " SELECT id, CASE WHEN NOT ho THEN cn WHEN cn = onm THEN cn WHEN cn = bn THEN onm ELSE cn END AS name, CASE WHEN NOT ho THEN ca WHEN ca = oa THEN ca WHEN ca = ba THEN oa ELSE ca END AS nation FROM j WHERE hc AND (ho OR NOT sc)")
def three_way_merge(spark, d):
    return _three(spark, d)[0]


@query(THREE + " SELECT id, 'name' AS field FROM j WHERE hc AND ho AND cn <> onm AND cn <> bn AND onm <> bn UNION ALL SELECT id, 'nation' FROM j WHERE hc AND ho AND ca <> oa AND ca <> ba AND oa <> ba UNION ALL SELECT id, 'deleted' FROM j WHERE (hc AND NOT ho AND NOT sc) OR (ho AND NOT hc AND NOT so)")
def three_way_conflicts(spark, d):
    return _three(spark, d)[1]


# --- feedback and impact

NOW = "1998-12-31 00:00:00"
VOTE = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


def _docs(spark, d) -> DataFrame:
    e = load(spark, d, "events")[0]
    out = F.when(F.col("event_type") == "purchase", "useful").when(F.col("event_type") == "error", "dead_end")
    return e.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("date"), out.alias("outcome"), F.array(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))).alias("source_nodes"))


@query(f"""WITH e AS (SELECT 'u' || CAST(user_id % 50 AS VARCHAR) AS node, {VOTE} AS s, ts FROM events WHERE event_type IN ('purchase', 'error')), g AS (SELECT node, COUNT(*) FILTER (s > 0) AS pos, COUNT(*) FILTER (s < 0) AS neg, ROUND(SUM(s * pow(0.5, GREATEST(0.0, (epoch_us(TIMESTAMP '2026-01-01 00:00:00') - epoch_us(ts)) / 86400e6) / 3650.0)), 6) AS score FROM e GROUP BY 1)
SELECT node, pos, neg, score, CASE WHEN neg > 0 THEN CASE WHEN score > 0 THEN 'contested: useful' WHEN score < 0 THEN 'contested: dead end' ELSE 'contested: even' END WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS verdict FROM g WHERE pos > 0""")
def lessons_decay(spark, d):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return feedback.lessons(_docs(spark, d), now, 3650.0).select("node", "pos", "neg", F.round("score", 6).alias("score"), "verdict")


@query("SELECT conv_id, turn, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r = 1")
def latest_question(spark, d):
    return feedback.latest(load(spark, d, "conversations")[0], "conv_id", "turn").select("conv_id", "turn", "text")


@query("""WITH e AS (SELECT DISTINCT o_orderkey AS doc_id, l_partkey, 'size ' || CAST(p_size % 4 AS VARCHAR) AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0), n AS (SELECT doc_id, c, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY COUNT(*) DESC, c) r FROM e GROUP BY 1, 2)
SELECT o_orderkey AS doc_id, COALESCE(c, 'Uncategorized') AS community FROM orders LEFT JOIN n ON doc_id = o_orderkey AND r = 1""")
def doc_plurality(spark, d):
    orders, line, part = load(spark, d, "orders", "lineitem", "part")
    cited = line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_partkey").alias("source_nodes"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id")).join(cited, "doc_id", "left")
    home = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("size "), (F.col("p_size") % 4).cast("string")).alias("community"))
    return feedback.plurality(docs, home)


@query("""SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'P' THEN 'WRONG-BASE' WHEN o_orderpriority LIKE '1%' THEN 'CI-FAIL' WHEN o_orderpriority LIKE '2%' THEN 'CHANGES-REQ' WHEN o_orderkey % 10 = 0 THEN 'DRAFT' WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-01-01 00:00:00') >= 14 THEN 'STALE' WHEN o_orderpriority LIKE '3%' THEN 'APPROVED' WHEN o_orderpriority LIKE '4%' THEN 'PENDING' ELSE 'READY' END AS status FROM orders""")
def pr_status(spark, d):
    o = load(spark, d, "orders")[0]
    p = F.substring("o_orderpriority", 1, 1)
    ci = F.when(p == "1", "FAILURE").when(p == "4", "PENDING").otherwise("SUCCESS")
    review = F.when(p == "2", "CHANGES_REQUESTED").when(p == "3", "APPROVED")
    return o.select(F.col("o_orderkey").alias("number"), impact.status(F.when(F.col("o_orderstatus") == "P", "dev").otherwise("main"), F.lit("main"), ci, F.coalesce(review, F.lit("")), F.col("o_orderkey") % 10 == 0, F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("status"))


TOUCH = "SELECT DISTINCT l_orderkey AS number, l_partkey % 50 AS f FROM lineitem"


def _requests(spark, d) -> tuple[DataFrame, DataFrame]:
    line, part = load(spark, d, "lineitem", "part")
    file = lambda c: F.concat(F.lit("src/f"), (F.col(c) % 50).cast("string"), F.lit(".py"))
    line = line.select("l_orderkey", "l_partkey").repartition(width(spark), "l_orderkey")  # gathered after the shuffle, not in the few tasks that read
    r = line.groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_set(F.concat(F.lit("repo/"), file("l_partkey"))).alias("files"))
    return r, part.select(F.col("p_partkey").alias("id"), file("p_partkey").alias("source_file"), (F.col("p_partkey") % 50 % 7).cast("int").alias("community"))


@query(f"""WITH t AS ({TOUCH}), n AS (SELECT p_partkey % 50 AS f, COUNT(*) AS n FROM part GROUP BY 1)
SELECT number, array_to_string(list_sort(list(DISTINCT f % 7)), ',') AS communities, CAST(SUM(n) AS BIGINT) AS nodes FROM t JOIN n USING (f) GROUP BY number""")
def pr_impact(spark, d):
    r, n = _requests(spark, d)
    return impact.impact(r, n).select("number", F.array_join(F.transform("communities", lambda c: c.cast("string")), ",").alias("communities"), "nodes")


@query(f"WITH t AS ({TOUCH}) SELECT CAST(f % 7 AS INT) AS community, COUNT(DISTINCT number) AS n, MIN(number) AS first, MAX(number) AS last FROM t GROUP BY 1 HAVING COUNT(DISTINCT number) > 1")
def pr_conflicts(spark, d):
    return impact.conflicts(*_requests(spark, d))


# --- documents


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n_words FROM documents")
def doc_words(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", X.words(F.col("text")).cast("long").alias("n_words"))


_SIGNAL_SQL = " + ".join("CAST(regexp_matches(substring(text, 1, 3000), '" + p.replace("'", "''") + "') AS INT)" for p in X.PAPER)


@query(f"SELECT doc_id, {_SIGNAL_SQL} AS signals FROM documents")
def doc_paper_signals(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", X.paper_signals(F.col("text")).alias("signals"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '" + P.SECRETS[0][1] + "') THEN 'private_key' WHEN regexp_matches(text, '" + P.SECRETS[1][1] + "') THEN 'provider_key' END AS reason FROM documents")
def doc_secrets_provider(spark, d):
    t = F.col("text")
    return load(spark, d, "documents")[0].select("doc_id", F.when(t.rlike(P.SECRETS[0][1]), "private_key").when(t.rlike(P.SECRETS[1][1]), "provider_key").alias("reason"))


_SECRET = "length(v) >= 12 AND regexp_matches(v, '[A-Z]')::INT + regexp_matches(v, '[0-9]')::INT + regexp_matches(v, '[^A-Za-z0-9]')::INT + regexp_matches(v, '[a-z]')::INT >= 3 AND NOT regexp_matches(lower(v), 'example|placeholder|changeme|your[_-]|dummy|xxxx|<.*>|\\$\\{')"
_REASON = "CASE WHEN regexp_matches(text, '" + P.SECRETS[0][1] + "') THEN 'private_key' WHEN regexp_matches(text, '" + P.SECRETS[1][1] + "') THEN 'provider_key' WHEN len(list_filter(regexp_extract_all(text, '" + P.ASSIGNED.replace("'", "''") + f"', 1), lambda v: {_SECRET})) > 0 THEN 'secret_assignment' END"


#: Texts with planted secrets: what the given ones hold (hex digests) is no secret by the rule of three classes.
_PLANTED = "(SELECT doc_id, text || CASE doc_id % 8 WHEN 0 THEN ' api_key = Zx9-qwerty-Q1w2' WHEN 1 THEN ' -----BEGIN RSA PRIVATE ' || 'KEY-----' WHEN 2 THEN ' AKIA' || 'ABCDEFGHIJKLMNOP' WHEN 3 THEN ' token: example-Placeholder1' ELSE '' END AS text FROM documents)"


def _planted(spark, d) -> DataFrame:
    k, f = F.col("doc_id") % 8, lambda *xs: F.concat(F.lit(" "), *map(F.lit, xs))
    more = F.when(k == 0, f("api_key = Zx9-qwerty-Q1w2")).when(k == 1, f("-----BEGIN RSA PRIVATE ", "KEY-----")).when(k == 2, f("AKIA", "ABCDEFGHIJKLMNOP")).when(k == 3, f("token: example-Placeholder1")).otherwise("")
    return load(spark, d, "documents")[0].select("doc_id", F.concat("text", more).alias("text"))


@query(f"SELECT doc_id, {_REASON} AS reason FROM {_PLANTED}")
def doc_secrets(spark, d):
    return _planted(spark, d).select("doc_id", P.credential_content(F.col("text")).alias("reason"))


@query("WITH c AS (SELECT p_partkey, UNNEST(string_split(lower(p_name), '')) AS ch FROM part), n AS (SELECT p_partkey, ch, COUNT(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT p_partkey, SUM(n) AS t FROM n GROUP BY 1) SELECT p_partkey, ROUND(-SUM(n / t * log2(n / t)), 9) AS entropy FROM n JOIN t USING (p_partkey) GROUP BY 1")
def label_entropy(spark, d):
    return load(spark, d, "part")[0].select("p_partkey", F.round(X.entropy(F.lower("p_name")), 9).alias("entropy"))


@query("SELECT p_partkey, len(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)))) AS n FROM part")
def label_shingles(spark, d):
    return load(spark, d, "part")[0].select("p_partkey", F.size(X.shingles(F.col("p_name"))).cast("long").alias("n"))


_PAGE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_PAGE} AS text FROM pages")
def page_markdown(spark, d):
    return load(spark, d, "pages")[0].select("page_id", X.page_markdown(F.col("html")).alias("text"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://[^/?#]*arxiv\\.org') THEN 'arxiv' WHEN regexp_matches(lower(url), '^https?://[^?#]*\\.pdf($|[?#])') THEN 'pdf' ELSE 'webpage' END AS kind FROM pages")
def url_kinds(spark, d):
    return load(spark, d, "pages")[0].select("page_id", X.url_kind(F.col("url")).alias("kind"))


@query("""WITH o AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 10 = 4 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 5)
SELECT COALESCE(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def manifest_delta(spark, d):
    docs = load(spark, d, "documents")[0].select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    # the fixture's edits: some documents are new, some gone, some changed
    old = docs.where("doc_id % 10 <> 3").select("path", F.md5("text").alias("hash"))
    new = docs.where("doc_id % 10 <> 5").select("path", F.md5(F.expr("if(doc_id % 10 = 4, text || '.', text)")).alias("hash"))
    return prepare.manifest_delta(old, new)


@query("SELECT doc_id, CAST(FLOOR((LEAST(length(text), 20000) + 160) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", prepare.token_estimate(F.col("text")).alias("tokens"))


@query()
def doc_slices(spark, d):
    return prepare.slices(load(spark, d, "documents")[0], 4000).drop("text")


@query()
def fuzzy_names(spark, d):
    """Part names beside misspelt ones (two letters swapped): all parts, each name once as it is and once misspelt."""
    from tessella.operators.entity import candidates, fuzzy_pairs

    part = load(spark, d, "part")[0]
    label = F.concat(F.lit("entity "), F.translate(F.col("p_name"), "#", " "), F.lit(" of brand "), F.translate("p_brand", "#", " "))
    swapped = F.concat(F.substring(label, 1, 8), F.substring(label, 10, 1), F.substring(label, 9, 1), F.expr("substring(label, 11)"))
    rows = part.withColumn("label", label)
    kinds = [(rows, F.col("label"), "p"), (rows, swapped, "q")]
    out = [df.select(F.concat(F.lit(p), F.col("p_partkey").cast("string")).alias("id"), x.alias("label"), F.lit("concept").alias("file_type"), F.lit("a.md").alias("source_file"), F.col("p_partkey").alias("pos")) for df, x, p in kinds]
    return fuzzy_pairs(candidates(out[0].union(out[1])))


# --- predicates and resolution


@query(" SELECT source, target, \"key\" FROM edges WHERE confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND confidence_score >= 0.85)", True)
def sure_edges(spark, d):
    return supply_graph(spark, d)[1].where(sections.include_edge(F.col("confidence"), F.col("confidence_score"))).select("source", "target", "key")


@query(" SELECT id, CASE WHEN regexp_matches(source_file, '\\.(py|rs)$') THEN 'code' ELSE 'doc' END AS category, split_part(source_file, '/', 1) AS top, FALSE AS test, CASE WHEN regexp_matches(source_file, '\\.(py|rs)$') THEN 'code' ELSE 'document' END AS kind FROM nodes", True)
def path_predicates(spark, d):
    s = F.col("source_file")
    return supply_graph(spark, d)[0].select("id", P.category(s).alias("category"), P.top_dir(s).alias("top"), P.is_test(s).alias("test"), P.kind_of(s).alias("kind"))


@query(" SELECT arg_max(\"key\", \"key\") AS \"key\", source, target FROM edges GROUP BY source, target", True)
def class_digraph(spark, d):
    return merge.to_class(supply_graph(spark, d)[1], "digraph", "key").select("key", "source", "target")


@query(", u AS (SELECT label, MIN(id) AS id FROM nodes GROUP BY label HAVING COUNT(DISTINCT id) = 1) SELECT s_name AS source, COALESCE(u.id, n_name) AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN u ON label = n_name", True)
def alias_endpoints(spark, d):
    nodes = supply_graph(spark, d)[0].where("id not like 'supplier:%'")
    supplier, nation = load(spark, d, "supplier", "nation")
    e = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    return merge.resolve_ends(nodes, e)


@query(", n AS (SELECT p_partkey AS k, lower(p_name) || ' ' || CAST(p_partkey % 900 AS VARCHAR) AS name FROM part), u AS (SELECT name, MIN(k) AS k FROM n GROUP BY 1 HAVING COUNT(*) = 1), known AS (SELECT DISTINCT source, target FROM edges WHERE relation = 'calls' AND confidence = 'EXTRACTED') SELECT c.source, c.target, 'calls' AS relation, 'INFERRED' AS confidence, CAST(0.8 AS DOUBLE) AS confidence_score FROM (SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS source, 'part:' || CAST(u.k AS VARCHAR) AS target FROM lineitem JOIN n ON l_partkey = n.k JOIN u ON n.name = u.name) c ANTI JOIN known ON c.source = known.source AND c.target = known.target", True)
def unique_calls(spark, d):
    """Every line item as a call by a name that some parts share; calls that were extracted are known already."""
    from tessella.operators.calls import unique_calls as resolve

    edges = supply_graph(spark, d)[1]
    line, part = load(spark, d, "lineitem", "part")
    name = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 900).cast("string"))
    nodes = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), name.alias("label"), F.lit("code").alias("file_type"))
    calls = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("caller"), name.alias("callee"), F.lit(False).alias("is_member_call"), F.lit("supply/supplier.py").alias("source_file"))
    return resolve(calls, nodes, edges.where("confidence = 'EXTRACTED'"))


@query(f"SELECT doc_id, r AS reason, digest FROM (SELECT doc_id, {_REASON} AS r, sha256(text) AS digest FROM {_PLANTED}) WHERE r IS NOT NULL")
def egress_blocked(spark, d):
    docs = _planted(spark, d).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    out = prepare.egress(docs).where("not eligible")
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "reason", "digest")


@query("SELECT 'demo::c' || CAST(c_custkey AS VARCHAR) AS id, 'c' || CAST(c_custkey AS VARCHAR) AS local_id, 'demo' AS repo FROM customer")
def repo_prefix(spark, d):
    return merge.with_repo(load(spark, d, "customer")[0].select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")), "demo", ["id"]).select("id", "local_id", "repo")


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 80 OR len(string_split_regex(trim(p_name), '[ \\t]+')) >= 8 THEN regexp_matches(p_name, '[.!?:]') ELSE FALSE END AS sentence, lower(p_name) AS bare FROM part")
def label_predicates(spark, d):
    return load(spark, d, "part")[0].select("p_partkey", prepare.sentence_like(F.col("p_name")).alias("sentence"), X.bare_name(F.col("p_name")).alias("bare"))


@query()
def wiki_articles(spark, d):
    from tessella.sources.sinks import wiki

    return wiki(*supply_graph(spark, d))


@query()
def token_benchmark(spark, d):
    return prepare.token_reduction(load(spark, d, "documents")[0], answer_question(spark, d))



# --- sections, sinks


@query(r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS p FROM pages), n AS (SELECT p, COUNT(*) AS n, string_split(p, '/') AS s FROM p GROUP BY p), x AS (SELECT n, s, UNNEST(range(1, len(s) + 1)) AS i FROM n)
SELECT array_to_string(s[1:i], '/') AS prefix, CAST(i AS INT) AS depth, COUNT(*) AS files, CAST(SUM(n) AS BIGINT) AS items FROM x GROUP BY 1, 2""")
def dir_rollup(spark, d):
    return sections.path_rollup(load(spark, d, "pages")[0].select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path")))


HOME = ", h AS (SELECT id, split_part(id, ':', 1) AS section FROM nodes WHERE id NOT LIKE 'region:%'), k AS (SELECT e.*, u.section a, v.section b FROM edges e LEFT JOIN h u ON source = u.id LEFT JOIN h v ON target = v.id)"


def _home(n: DataFrame) -> DataFrame:
    return n.where("id not like 'region:%'").select("id", F.split("id", ":")[0].alias("section"))


@query(HOME + " SELECT COALESCE(a, '') AS a, COALESCE(b, '') AS b, CASE WHEN a IS NULL OR b IS NULL THEN 'orphan' WHEN a = b THEN 'intra' ELSE 'inter' END AS kind, COUNT(*) AS n FROM k GROUP BY 1, 2, 3", True)
def edge_sections(spark, d):
    n, e = supply_graph(spark, d)
    return sections.classify(e, _home(n)).groupBy(F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"), "kind").agg(F.count("*").alias("n"))


@query(HOME + ", r AS (SELECT a, b, relation, COUNT(*) n FROM k WHERE a <> b GROUP BY 1, 2, 3) SELECT a, b, CAST(SUM(n) AS BIGINT) AS count, (array_agg(relation ORDER BY n DESC, relation))[1] AS relation FROM r GROUP BY 1, 2", True)
def section_summary(spark, d):
    n, e = supply_graph(spark, d)
    return sections.between(sections.classify(e, _home(n)))


@query(" SELECT id, CAST(SUM(s) AS DOUBLE) AS score FROM (SELECT source id, (CASE relation WHEN 'calls' THEN 3.0 WHEN 'uses' THEN 2.0 ELSE 1.0 END) * (CASE confidence WHEN 'EXTRACTED' THEN 1.0 ELSE 0.5 END) s FROM edges UNION ALL SELECT target, (CASE relation WHEN 'calls' THEN 3.0 WHEN 'uses' THEN 2.0 ELSE 1.0 END) * (CASE confidence WHEN 'EXTRACTED' THEN 1.0 ELSE 0.5 END) FROM edges) GROUP BY id", True)
def participation(spark, d):
    return sections.participation(supply_graph(spark, d)[1])


@query("SELECT section, word, n, rank FROM (SELECT section, word, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY section ORDER BY COUNT(*) DESC, word) AS INT) AS rank FROM (SELECT p_brand AS section, UNNEST(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS word FROM part) GROUP BY 1, 2) WHERE rank <= 5")
def section_keywords(spark, d):
    return sections.keywords(load(spark, d, "part")[0].select(F.col("p_brand").alias("section"), F.col("p_name").alias("label")))


def _quoted(c: str) -> str:
    """SQL for a text inside a single-quoted string of the graph language."""
    return f"replace(replace({c}, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39))"


_LINES = """ SELECT 'MERGE (n:' || upper(file_type[1:1]) || lower(file_type[2:]) || ' {id: ' || q || IDS || q || '}) SET n.label = ' || q || LABEL || q || ';' AS value FROM nodes, quote
UNION ALL SELECT 'MATCH (a {id: ' || q || SOURCE || q || '}), (b {id: ' || q || TARGET || q || '}) MERGE (a)-[r:' || upper(relation) || ' {key: ' || q || KEYS || q || '}]->(b) SET r.confidence = ' || q || confidence || q || ';' FROM edges, quote"""
for _word, _column in (("IDS", "id"), ("LABEL", "label"), ("SOURCE", "source"), ("TARGET", "target"), ("KEYS", '"key"')):
    _LINES = _LINES.replace(_word, _quoted(_column))


@query(", quote AS (SELECT chr(39) AS q)" + _LINES, True)
def cypher_lines(spark, d):
    return cypher(*supply_graph(spark, d))


@query()
def stream_merge(spark, d):
    """A stream of orders merged file by file; the stored table at the end."""
    from tessella.plans.materialize import scratch
    from tessella.streaming.updates import GraphTable, merge_stream

    base = scratch(spark, "stream")
    o = spark.read.parquet(f"{d}/orders.parquet")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/orders.parquet*")
    changes = stream.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_file"), (F.col("o_orderstatus") == "P").alias("deleted"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("pos"))
    table = GraphTable(spark, f"{base}/graph")
    merge_stream(changes, table, f"{base}/checkpoint").awaitTermination()
    return table.read()


ORACLE["stream_merge"] = "WITH o AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS label, 'c' || CAST(o_custkey AS VARCHAR) AS source_file, o_orderstatus = 'P' AS deleted, epoch_us(o_orderdate) AS pos FROM orders) SELECT id, label, source_file FROM o WHERE NOT deleted AND pos = (SELECT MAX(pos) FROM o o2 WHERE o2.source_file = o.source_file)"

from tessella.plans import registered as _registered  # noqa: E402, F401  (more queries, on the same registry)
