"""More registered queries: resolution, construction, feedback, views, scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators import answers, calls, community, entity, feedback, impact, library, merge, prepare, rank, sections, topology
from tessella.plans.queries import DEGREE, SCORES, _docs, query
from tessella.sources.graphs import load, supply_graph
from tessella.streaming.updates import quiet_groups

# --- resolution over parts and suppliers as code

_CODE = "code AS (SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS id, p_brand || ' ' || CAST(p_size AS VARCHAR) || '()' AS label, 'lib/d' || CAST(p_partkey % 5 AS VARCHAR) || '/f' || CAST(p_partkey % 40 AS VARCHAR) || '.py' AS source_file FROM part), cl AS (SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS caller, p_brand || ' ' || CAST(p_size AS VARCHAR) AS callee, 'lib/d' || CAST(l_suppkey % 5 AS VARCHAR) || '/f' || CAST(l_suppkey % 40 AS VARCHAR) || '.py' AS source_file FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _code(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes of code whose labels repeat, and a call by name for every line item."""
    part, line = load(spark, d, "part", "lineitem")
    file = lambda c: F.concat(F.lit("lib/d"), (F.col(c) % 5).cast("string"), F.lit("/f"), (F.col(c) % 40).cast("string"), F.lit(".py"))
    name = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"))
    nodes = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(name, F.lit("()")).alias("label"), file("p_partkey").alias("source_file"), F.lit("code").alias("file_type"))
    sites = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("caller"), name.alias("callee"), file("l_suppkey").alias("source_file"))
    return nodes, sites


@query(f"WITH {_CODE}, j AS (SELECT caller, callee, id, CASE WHEN code.source_file = cl.source_file THEN 1000000 WHEN split_part(code.source_file, '/', 2) = split_part(cl.source_file, '/', 2) THEN 500000 ELSE 1 END AS level FROM cl JOIN code ON lower(code.label) = lower(callee) || '()'), t AS (SELECT *, MAX(level) OVER (PARTITION BY caller, lower(callee)) AS top FROM j) SELECT DISTINCT source, target FROM (SELECT caller AS source, MIN(id) AS target, MAX(id) AS z FROM t WHERE level = top GROUP BY caller, lower(callee)) WHERE target = z")
def nearest_calls(spark, d):
    nodes, sites = _code(spark, d)
    return calls.nearest_candidates(sites, nodes)


@query(f"WITH {_CODE}, m AS (SELECT regexp_extract(source_file, 'f[0-9]+') AS module, lower(label) AS name, MIN(id) AS target FROM code GROUP BY 1, 2 HAVING MIN(id) = MAX(id)) SELECT DISTINCT caller AS source, target, 'calls' AS relation, 'EXTRACTED' AS confidence FROM cl JOIN m ON lower(callee) || '()' = name AND module = 'f7'")
def imported_calls(spark, d):
    """Every file imports every name of one module."""
    nodes, sites = _code(spark, d)
    imports = sites.select("source_file", F.lit("f7").alias("module"), F.col("callee").alias("name"), F.lit(None).cast("string").alias("alias")).distinct()
    return calls.imported_calls(sites, imports, nodes)


_OWNERS = "cls AS (SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS id, 'N' || CAST(s_suppkey % 60 AS VARCHAR) AS name FROM supplier), met AS (SELECT 'k' || CAST(l_suppkey AS VARCHAR) AS class_id, 'm' || CAST(l_partkey % 9 AS VARCHAR) AS name, 'x' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"


@query(f"WITH {_OWNERS}, u AS (SELECT lower(name) k, MIN(id) class_id FROM cls GROUP BY 1 HAVING MIN(id) = MAX(id)), m AS (SELECT class_id, name, arg_max(id, pos) target FROM met GROUP BY 1, 2) SELECT DISTINCT 'o' || CAST(o_orderkey AS VARCHAR) AS source, target FROM orders JOIN u ON 'n' || CAST(o_custkey % 60 AS VARCHAR) = k JOIN m ON m.class_id = u.class_id AND m.name = 'm' || CAST(o_orderkey % 9 AS VARCHAR)")
def member_calls(spark, d):
    supplier, line, orders = load(spark, d, "supplier", "lineitem", "orders")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    classes = supplier.select(c("N", F.col("s_suppkey") % 60).alias("name"), c("k", F.col("s_suppkey")).alias("id"))
    methods = line.select(c("k", F.col("l_suppkey")).alias("class_id"), c("m", F.col("l_partkey") % 9).alias("name"), F.concat_ws("-", c("x", F.col("l_orderkey")), F.col("l_linenumber").cast("string")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    sites = orders.select(c("o", F.col("o_orderkey")).alias("caller"), c("n", F.col("o_custkey") % 60).alias("receiver_type"), c("M", F.col("o_orderkey") % 9).alias("callee"))
    return calls.member_calls(sites, classes, methods)


@query("""WITH s AS (SELECT p_brand || CAST(p_size AS VARCHAR) AS symbol, 'd' || CAST(p_partkey % 6 AS VARCHAR) AS document, 'p' || CAST(p_partkey AS VARCHAR) AS id FROM part), r AS (SELECT DISTINCT 'o' || CAST(l_orderkey AS VARCHAR) AS source, CASE WHEN l_partkey % 50 = 0 THEN 'other' ELSE p_brand || CAST(p_size AS VARCHAR) END AS symbol, 'd' || CAST(l_orderkey % 6 AS VARCHAR) AS document FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT symbol, document, MIN(id) near FROM s GROUP BY 1, 2), u AS (SELECT symbol, MIN(id) far FROM s GROUP BY 1 HAVING MIN(id) = MAX(id)) SELECT source, COALESCE(near, far, 'external:' || r.symbol) AS target, 'references' AS relation, r.document FROM r LEFT JOIN h ON r.symbol = h.symbol AND r.document = h.document LEFT JOIN u ON r.symbol = u.symbol""")
def symbol_targets(spark, d):
    part, line = load(spark, d, "part", "lineitem")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    name = F.concat("p_brand", F.col("p_size").cast("string"))
    symbols = part.select(name.alias("symbol"), c("d", F.col("p_partkey") % 6).alias("document"), c("p", F.col("p_partkey")).alias("id"))
    refs = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(c("o", F.col("l_orderkey")).alias("source"), F.when(F.col("l_partkey") % 50 == 0, "other").otherwise(name).alias("symbol"), c("d", F.col("l_orderkey") % 6).alias("document"), F.lit("references").alias("relation")).distinct()
    return calls.symbol_targets(refs, symbols)


_TYPES = "t AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS ns, 'T' || CAST(s_suppkey % 40 AS VARCHAR) AS name, 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier), e AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'T1' ELSE 'type:T' || CAST(o_custkey % 50 AS VARCHAR) END AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'calls' ELSE 'inherits' END AS relation, CAST(o_orderkey % 3 AS VARCHAR) AS namespace FROM orders)"


@query(f"WITH {_TYPES}, a AS (SELECT ns, name, MIN(id) i FROM t GROUP BY 1, 2), u AS (SELECT name, MIN(id) i FROM t GROUP BY 1 HAVING MIN(id) = MAX(id)) SELECT source, COALESCE(a.i, u.i, target) AS target, relation, namespace FROM (SELECT *, CASE WHEN relation = 'inherits' AND target LIKE 'type:%' THEN substring(target, 6) END AS nm FROM e) x LEFT JOIN a ON a.ns = namespace AND a.name = nm LEFT JOIN u ON u.name = nm")
def type_references(spark, d):
    supplier, orders = load(spark, d, "supplier", "orders")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    types = supplier.select((F.col("s_nationkey") % 3).cast("string").alias("namespace"), c("T", F.col("s_suppkey") % 40).alias("name"), c("s", F.col("s_suppkey")).alias("id"), F.lit("x.cs").alias("source_file"))
    e = orders.select(c("o", F.col("o_orderkey")).alias("source"), F.when(F.col("o_orderkey") % 4 == 0, "T1").otherwise(c("type:T", F.col("o_custkey") % 50)).alias("target"), F.when(F.col("o_orderkey") % 3 == 0, "calls").otherwise("inherits").alias("relation"), (F.col("o_orderkey") % 3).cast("string").alias("namespace"))
    return calls.type_references(e, types)


@query(", u AS (SELECT label, MIN(id) i FROM nodes GROUP BY 1 HAVING MIN(id) = MAX(id)), c AS (SELECT DISTINCT p_name AS cited FROM part UNION SELECT 'supplier:' || CAST(s_suppkey + 3 AS VARCHAR) FROM supplier) SELECT cited, COALESCE(n.id, u.i) AS id FROM c LEFT JOIN (SELECT DISTINCT id FROM nodes) n ON cited = n.id LEFT JOIN u ON cited = u.label", True)
def cited_nodes(spark, d):
    part, supplier = load(spark, d, "part", "supplier")
    cited = part.select(F.col("p_name").alias("cited")).union(supplier.select(F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 3).cast("string"))))
    return feedback.canonical_nodes(cited, supply_graph(spark, d)[0])


# --- construction


@query("WITH n AS (SELECT 'a' || CAST(p_partkey AS VARCHAR) AS id, p_brand || '.py' AS file, lower(trim(p_name)) AS l, p_partkey % 3 <> 0 AS ast FROM part), s AS (SELECT file, l, MIN(id) AS new FROM n WHERE ast GROUP BY 1, 2 HAVING MIN(id) = MAX(id)) SELECT id AS old, new FROM n JOIN s USING (file, l) WHERE NOT ast AND id <> new UNION ALL SELECT 'm' || CAST(p_partkey AS VARCHAR), new FROM part JOIN s ON p_brand || '.py' = file AND lower(trim(p_name)) = l")
def ghost_merges(spark, d):
    part = load(spark, d, "part")[0]
    c = lambda p: F.concat(F.lit(p), F.col("p_partkey").cast("string"))
    n = part.select(c("a").alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("src/"), "p_brand", F.lit(".py")).alias("source_file"), F.when(F.col("p_partkey") % 3 != 0, "ast").alias("origin"))
    said = part.select(c("m"), F.upper("p_name"), F.concat(F.lit("other/"), "p_brand", F.lit(".py")), F.lit("semantic"))
    return merge.ghost_merges(n.union(said))


@query(" SELECT CASE WHEN source LIKE 'supplier:%' THEN 'supplier:' || CAST(CAST(split_part(source, ':', 2) AS BIGINT) // 2 AS VARCHAR) ELSE source END AS source, target, COUNT(*) AS n FROM edges GROUP BY 1, 2", True)
def remapped_edges(spark, d):
    supplier = load(spark, d, "supplier")[0]
    c = lambda x: F.concat(F.lit("supplier:"), x.cast("string"))
    table = supplier.select(c(F.col("s_suppkey")).alias("old"), c(F.floor(F.col("s_suppkey") / 2)).alias("new"))
    return merge.remap_ids(supply_graph(spark, d)[1], table).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(" SELECT source, target, relation, CASE WHEN ROW_NUMBER() OVER (PARTITION BY source, target, relation ORDER BY \"key\") = 1 THEN 'plain' ELSE 'salted' END AS kind FROM edges", True)
def salted_keys(spark, d):
    e = supply_graph(spark, d)[1].select("source", "target", F.col("relation").alias("key"), "confidence", "weight", F.col("key").alias("pos"))
    out = merge.salted_keys(e)
    return out.select("source", "target", F.substring_index("key", ":alt:", 1).alias("relation"), F.when(F.col("key").contains(":alt:"), "salted").otherwise("plain").alias("kind"))


@query(" SELECT COUNT(DISTINCT (source, target, relation, ordinal)) AS keys, COUNT(*) AS records FROM (SELECT source, target, relation, ROW_NUMBER() OVER (PARTITION BY source, target, relation ORDER BY \"key\") AS ordinal FROM edges)", True)
def salted_keys_are_distinct(spark, d):
    e = supply_graph(spark, d)[1].select("source", "target", F.col("relation").alias("key"), "confidence", "weight", F.col("key").alias("pos"))
    return merge.salted_keys(e).agg(F.countDistinct("source", "target", "key").alias("keys"), F.count("*").alias("records"))


_TWO = """a AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, c_name AS label, 'a.py' AS source_file FROM customer UNION ALL SELECT n_name, n_name, '' FROM nation), b AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS label, 'b.py' AS source_file FROM supplier UNION ALL SELECT n_name, n_name, '' FROM nation)"""


def _two(spark, d) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Customers and suppliers as graphs of two repositories that share the nations."""
    customer, supplier, nation = load(spark, d, "customer", "supplier", "nation")
    shared = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("label"), F.lit("").alias("source_file"))
    out = {}
    for tag, df, key, name, file, where in (("a", customer, "c_custkey", "c_name", "a.py", "c_nationkey"), ("b", supplier, "s_suppkey", "s_name", "b.py", "s_nationkey")):
        prefix = F.lit("c" if tag == "a" else "s")
        own = df.select(F.concat(prefix, F.col(key).cast("string")).alias("id"), F.col(name).alias("label"), F.lit(file).alias("source_file"))
        edges = df.join(nation, F.col(where) == F.col("n_nationkey")).select(F.concat(prefix, F.col(key).cast("string")).alias("source"), F.col("n_name").alias("target"), F.lit("in").alias("relation"), F.lit("").alias("key"))
        out[tag] = (own.union(shared), edges)
    return out


@query(f"WITH {_TWO} SELECT 'a::' || id AS id, label, CASE WHEN source_file = '' THEN 'a,b' ELSE 'a' END AS owners FROM a UNION ALL SELECT 'b::' || id, label, 'b' FROM b WHERE source_file <> ''")
def composed_nodes(spark, d):
    return merge.compose(_two(spark, d))[0].select("id", "label", F.array_join("owners", ",").alias("owners"))


@query("SELECT 'a::c' || CAST(c_custkey AS VARCHAR) AS source, 'a::' || n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'b::s' || CAST(s_suppkey AS VARCHAR), 'a::' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def composed_edges(spark, d):
    return merge.compose(_two(spark, d))[1].select("source", "target")


@query(f"WITH {_TWO} SELECT CASE WHEN source_file = '' THEN 'a::' ELSE 'b::' END || id AS id, 'b' AS owners FROM b")
def detached_repo(spark, d):
    return merge.detach(merge.compose(_two(spark, d))[0], "a").select("id", F.array_join("owners", ",").alias("owners"))


@query("SELECT 'a' AS repo, (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM nation) AS nodes, (SELECT COUNT(*) FROM customer) AS edges UNION ALL SELECT 'b', (SELECT COUNT(*) FROM supplier) + (SELECT COUNT(*) FROM nation), (SELECT COUNT(*) FROM supplier)")
def library_listing(spark, d):
    """Two repositories added, one of them twice: the second time nothing is done."""
    two = _two(spark, d)
    lib, entries, _ = library.add_repo(None, {}, "a", *two["a"])
    lib, entries, _ = library.add_repo(lib, entries, "b", *two["b"])
    lib, entries, _ = library.add_repo(lib, entries, "a", *two["a"])
    return library.list_repos(lib)


@query(f"WITH {_TWO} SELECT CASE WHEN source_file = '' THEN 'a::' ELSE 'b::' END || id AS id, 'b' AS owners FROM b")
def library_removal(spark, d):
    two = _two(spark, d)
    lib, entries, _ = library.add_repo(None, {}, "a", *two["a"])
    lib, entries, _ = library.add_repo(lib, entries, "b", *two["b"])
    lib, _, _ = library.remove_repo(lib, entries, "a")
    return lib[0].select("id", F.array_join("owners", ",").alias("owners"))


@query("SELECT TRUE AS same_rows, FALSE AS one_less, TRUE AS same_mark")
def topology_compare(spark, d):
    e = supply_graph(spark, d)[1]
    cols = ["source", "target", "key"]
    less = e.where("not (source = 'nation:0')")
    row = (merge.same_topology(e, e.repartition("target"), cols), merge.same_topology(e, less, cols), merge.fingerprint(e, cols) == merge.fingerprint(e.repartition("key"), cols))
    return spark.createDataFrame([row], "same_rows boolean, one_less boolean, same_mark boolean")


_KEYED = "k AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relation, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || CAST(l_linenumber % 4 AS VARCHAR) END AS \"key\", l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"


@query(f'WITH {_KEYED}, h AS (SELECT DISTINCT source, target, relation FROM k WHERE "key" IS NOT NULL) SELECT source, target, relation, COALESCE("key", \'\') AS "key", MIN(pos) AS pos FROM k WHERE "key" IS NOT NULL OR (source, target, relation) NOT IN (SELECT (source, target, relation) FROM h) GROUP BY 1, 2, 3, 4'.replace("(source, target, relation) NOT IN (SELECT (source, target, relation) FROM h)", "NOT EXISTS (SELECT 1 FROM h WHERE h.source = k.source AND h.target = k.target AND h.relation = k.relation)"))
def keyed_edges(spark, d):
    line = load(spark, d, "lineitem")[0]
    e = line.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("k"), (F.col("l_linenumber") % 4).cast("string"))).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return merge.keyed_first(e).select("source", "target", "relation", F.coalesce("key", F.lit("")).alias("key"), "pos")


@query(" SELECT source, target, \"key\" FROM edges WHERE target NOT LIKE 'part:%' OR CAST(split_part(target, ':', 2) AS BIGINT) % 4 <> 0", True)
def checked_ends(spark, d):
    n, e = supply_graph(spark, d)
    gone = F.col("id").startswith("part:") & (F.substring_index("id", ":", -1).cast("long") % 4 == 0)
    return merge.checked_ends(n.where(~gone), e.withColumn("origin", F.lit("ast"))).select("source", "target", "key")


@query("WITH g AS (SELECT p_brand, p_size, MIN(p_partkey) k FROM part WHERE p_partkey % 5 = 0 GROUP BY 1, 2 HAVING COUNT(*) = 1), h AS (SELECT p_brand, p_size, MIN(p_partkey) k FROM part WHERE p_partkey % 5 = 1 GROUP BY 1, 2 HAVING COUNT(*) = 1) SELECT 'old' || CAST(g.k AS VARCHAR) AS old, 'new' || CAST(h.k AS VARCHAR) AS new FROM g JOIN h USING (p_brand, p_size)")
def renamed_nodes(spark, d):
    part = load(spark, d, "part")[0]
    side = lambda df, p, at: df.select(F.concat(F.lit(p), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("source_file"), F.col("p_size").cast("string").alias("label"), F.lit("code").alias("file_type"), F.lit(at).alias("source_location"))
    return merge.renamed_nodes(side(part.where("p_partkey % 5 = 0"), "old", "L1"), side(part.where("p_partkey % 5 = 1"), "new", "L2"))


@query(" SELECT 'edges' AS channel, id FROM (SELECT DISTINCT target AS id FROM edges WHERE target LIKE 'region:%') UNION ALL SELECT 'cited', 'lost:' || CAST(n_nationkey AS VARCHAR) FROM nation", True)
def unresolved_references(spark, d):
    n, e = supply_graph(spark, d)
    cited = load(spark, d, "nation")[0].select(F.concat(F.lit("lost:"), F.col("n_nationkey").cast("string")).alias("id"))
    return merge.unresolved(n.where("id not like 'region:%'"), edges=e.select(F.col("target").alias("id")), cited=cited)


@query(" SELECT source, target, \"key\" FROM edges WHERE NOT (source = 'supplier:1' AND target = 'part:2') AND NOT (source = 'nation:3' AND target = 'region:1')", True)
def without_pair(spark, d):
    return merge.without_pair(merge.without_pair(supply_graph(spark, d)[1], "part:2", "supplier:1"), "nation:3", "region:1").select("source", "target", "key")


@query(" SELECT target AS source, source AS target, relation, \"key\" FROM edges WHERE relation = 'uses'", True)
def lifted_edges(spark, d):
    e = supply_graph(spark, d)[1].where("relation = 'uses'")
    return merge.lifted(e.withColumn("true_src", F.col("target")).withColumn("true_tgt", F.col("source"))).select("source", "target", "relation", "key")


@query("WITH g AS (SELECT p_brand AS id, COUNT(DISTINCT p_size % 3) AS n FROM part GROUP BY 1) SELECT DISTINCT p_brand AS id, 'f' || CAST(p_size % 3 AS VARCHAR) AS source_file, CASE WHEN n > 1 THEN p_brand || '_' || substring(sha1('f' || CAST(p_size % 3 AS VARCHAR)), 1, 6) ELSE p_brand END AS scoped FROM part JOIN g ON id = p_brand")
def scoped_ids(spark, d):
    return prepare.scoped_ids(load(spark, d, "part")[0].select(F.col("p_brand").alias("id"), F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string")).alias("source_file")))


@query("SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ast' ELSE 'semantic' END AS origin FROM orders")
def merged_fragments(spark, d):
    o = load(spark, d, "orders")[0].select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "ast").alias("origin"))
    even = F.substring_index("id", "o", -1).cast("long") % 2 == 0
    return library.merged_fragments(o.where(even), o.where(~even))


_HYPER = "SELECT l_orderkey, list_sort(list(DISTINCT 'p' || CAST(l_partkey AS VARCHAR))) AS nodes FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_partkey) >= 2"


@query(f"WITH m AS ({_HYPER}) SELECT 'h' || CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS label, array_to_string(nodes, ',') AS nodes FROM m")
def attached_hyperedges(spark, d):
    line, part = load(spark, d, "lineitem", "part")
    h = line.groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("nodes")).select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("id"), "l_orderkey", F.lit("order").alias("relation"), "nodes")
    live = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    out = library.attached(h.where("l_orderkey % 2 = 0").withColumn("label", F.lit("before")), h.withColumn("label", F.lit("after")), live)
    return out.select("id", "label", F.array_join("nodes", ",").alias("nodes"))


@query("WITH m AS (SELECT l_orderkey AS k, CAST(l_suppkey AS VARCHAR) AS s, MIN(l_linenumber) AS p FROM lineitem GROUP BY 1, 2) SELECT 'h' || CAST(k AS VARCHAR) AS id, string_agg('s' || s, ',' ORDER BY p, CAST(s AS BIGINT)) AS nodes FROM m GROUP BY k")
def repaired_aliases(spark, d):
    """Hyperedges that name suppliers' files by path or by an id made of it."""
    line, supplier = load(spark, d, "lineitem", "supplier")
    file = lambda c: F.concat(F.lit("src/Sup"), c.cast("string"), F.lit(".py"))
    nodes = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), file(F.col("s_suppkey")).alias("source_file")).withColumn("label", F.substring_index("source_file", "/", -1))
    named = F.when(F.col("l_linenumber") % 2 == 0, file(F.col("l_suppkey"))).otherwise(F.concat(F.lit("src_sup"), F.col("l_suppkey").cast("string")))
    h = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", named.alias("m")))), lambda x: x["m"]).alias("nodes")).select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("id"), "nodes")
    return library.repaired_aliases(nodes, h).select("id", F.array_join("nodes", ",").alias("nodes"))


@query("WITH m AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT 'too many nodes' AS rule, CAST(COUNT(*) AS VARCHAR) AS subject FROM part HAVING COUNT(*) > 100 UNION ALL SELECT 'too many edges', CAST(COUNT(*) AS VARCHAR) FROM lineitem HAVING COUNT(*) > 1000 UNION ALL SELECT CASE WHEN n > 5 THEN 'too many members' ELSE 'fewer than two members' END, 'h' || CAST(l_orderkey AS VARCHAR) FROM m WHERE n > 5 OR n < 2")
def fragment_bounds(spark, d):
    line, part = load(spark, d, "lineitem", "part")
    h = line.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("nodes")).select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("id"), "nodes")
    return library.fragment_violations(part, line, h, 100, 1000, 5)


@query("SELECT 'unknown relation' AS rule, 'o' || CAST(o_orderkey AS VARCHAR) || ' -> c' || CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'score out of range', 'o' || CAST(o_orderkey AS VARCHAR) || ' -> c' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 0")
def strict_fragment(spark, d):
    orders, customer = load(spark, d, "orders", "customer")
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = orders.select(c("o", "o_orderkey").alias("id")).union(customer.select(c("c", "c_custkey"))).select("id", F.col("id").alias("label"), F.lit("code").alias("file_type"), F.lit("a.py").alias("source_file"))
    e = orders.select(c("o", "o_orderkey").alias("source"), c("c", "o_custkey").alias("target"), F.when(F.col("o_orderstatus") == "P", "odd").otherwise("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.when(F.col("o_orderkey") % 7 == 0, 1.5).otherwise(0.5).alias("confidence_score"))
    return merge.strict_violations(nodes, e, ["uses"])


@query("WITH g AS (SELECT c_nationkey AS n, array_to_string(list_sort(list(DISTINCT c_mktsegment)), chr(10) || chr(10)) AS rationale FROM customer GROUP BY 1) SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, COALESCE(rationale, '') AS rationale FROM nation LEFT JOIN g ON n = n_nationkey")
def folded_rationale(spark, d):
    customer, nation = load(spark, d, "customer", "nation")
    note = customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("label"), F.lit("rationale").alias("file_type"), F.col("c_nationkey").alias("n"))
    nodes = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("code").alias("file_type")).union(note.drop("n"))
    e = note.select(F.col("id").alias("source"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("target"), F.lit("rationale_for").alias("relation"))
    return prepare.sanitised(nodes, e)[0].select("id", F.coalesce("rationale", F.lit("")).alias("rationale"))


@query("WITH o AS (SELECT DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE l_suppkey END AS source, l_partkey AS target FROM lineitem) SELECT 's' || CAST(source AS VARCHAR) AS source, 'p' || CAST(target AS VARCHAR) AS target FROM o")
def rewired_edges(spark, d):
    line, supplier = load(spark, d, "lineitem", "supplier")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    remap = supplier.where("s_suppkey % 4 = 0").select(c("s", F.col("s_suppkey")).alias("old"), F.lit("s1").alias("new"))
    return entity.rewire(line.select(c("s", F.col("l_suppkey")).alias("source"), c("p", F.col("l_partkey")).alias("target")), remap)


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, FIRST_VALUE('p' || CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY lower(trim(p_name)) ORDER BY length('p' || CAST(p_partkey AS VARCHAR)), 'p' || CAST(p_partkey AS VARCHAR)) AS keep FROM part")
def label_winners(spark, d):
    return entity.label_winner(load(spark, d, "part")[0].select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label")))


@query("WITH g AS (SELECT p_size, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS n, MIN('p' || CAST(p_partkey AS VARCHAR)) AS a FROM part GROUP BY 1, 2) SELECT a, 'p' || CAST(p_partkey AS VARCHAR) AS b FROM part p JOIN g ON g.p_size = p.p_size AND g.n = regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') WHERE a <> 'p' || CAST(p_partkey AS VARCHAR)")
def exact_merges(spark, d):
    n = load(spark, d, "part")[0].select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("label"), F.lit("concept").alias("file_type"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("source_file"))
    return entity.exact_pairs(n)


# --- feedback and requests


@query("SELECT o_orderkey AS number, CASE o_orderkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'FAILURE' ELSE 'FAILURE' END AS state FROM orders")
def ci_rollup(spark, d):
    k = F.col("o_orderkey") % 5
    checks = F.when(k == 1, F.array(F.lit("success"), F.lit("SUCCESS"))).when(k == 2, F.array(F.lit("SUCCESS"), F.lit("IN_PROGRESS"))).when(k == 3, F.array(F.lit("FAILURE"), F.lit("PENDING"))).when(k == 4, F.array(F.lit("timed_out")))
    return load(spark, d, "orders")[0].select(F.col("o_orderkey").alias("number"), impact.ci_state(checks).alias("state"))


@query("WITH e AS (SELECT 'u' || CAST(user_id % 50 AS VARCHAR) AS node, ts, props || CAST(event_id AS VARCHAR) AS question FROM events WHERE event_type = 'purchase') SELECT node, question, CAST(r AS INT) AS rank FROM (SELECT node, question, ROW_NUMBER() OVER (PARTITION BY node ORDER BY ts DESC, question DESC) AS r FROM e) WHERE r <= 5")
def provenance(spark, d):
    docs = _docs(spark, d).join(load(spark, d, "events")[0].select(F.col("event_id").alias("doc_id"), F.concat("props", F.col("event_id").cast("string")).alias("question")), "doc_id")
    return feedback.provenance(docs).select("node", "question", "rank")


_VERDICT = "WITH v AS (SELECT DISTINCT 'part:' || CAST(p_partkey AS VARCHAR) AS id, p_size % 3 AS a, (p_size + p_partkey) % 3 AS b FROM part) SELECT id, CASE LEAST(a, b) WHEN 0 THEN 'preferred' WHEN 1 THEN 'contested: even' ELSE 'tentative' END AS status FROM v"


@query(_VERDICT)
def overlay(spark, d):
    """Two verdicts on every part."""
    part = load(spark, d, "part")[0]
    name = lambda c: F.when(c == 0, "preferred").when(c == 1, "contested: even").otherwise("tentative")
    node = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    v = part.select(node.alias("node"), name(F.col("p_size") % 3).alias("verdict")).union(part.select(node, name((F.col("p_size") + F.col("p_partkey")) % 3)))
    return feedback.overlay(v, supply_graph(spark, d)[0])


@query("SELECT doc_id, doc_id % 10 IN (3, 4) AS stale FROM documents")
def stale_marks(spark, d):
    docs = load(spark, d, "documents")[0]
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", path.alias("source_file"), F.md5("text").alias("code_hash"))
    files = docs.where("doc_id % 10 <> 3").select(path.alias("path"), F.md5(F.expr("if(doc_id % 10 = 4, text || '.', text)")).alias("hash"))
    return feedback.stale(marked, files).select("doc_id", "stale")


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 10 IN (3, 4)")
def changed_during_run(spark, d):
    docs = load(spark, d, "documents")[0]
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return answers.changed_during(docs.select(path.alias("path"), F.md5("text").alias("hash")), docs.where("doc_id % 10 <> 3").select(path.alias("path"), F.md5(F.expr("if(doc_id % 10 = 4, text || '.', text)")).alias("hash")))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 10 = 4 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 10 NOT IN (5, 6)")
def manifest_update(spark, d):
    docs = load(spark, d, "documents")[0].select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    old = docs.where("doc_id % 10 <> 5").select("path", F.md5("text").alias("hash"))
    new = docs.where("doc_id % 10 = 4").select("path", F.md5(F.concat("text", F.lit("."))).alias("hash"))
    return prepare.update_manifest(old, new, docs.where("doc_id % 10 = 6").select("path"))


@query("SELECT doc_id % 3 = 0 AS hit, COUNT(*) AS n FROM documents GROUP BY 1")
def cache_hits(spark, d):
    docs = load(spark, d, "documents")[0].select("doc_id", F.concat(F.md5("text"), F.col("doc_id").cast("string")).alias("hash"))
    hits, misses = prepare.cache_lookup(docs, docs.where("doc_id % 3 = 0").select("hash", F.lit(1).alias("cached")))
    return hits.agg(F.lit(True).alias("hit"), F.count("*").alias("n")).union(misses.agg(F.lit(False), F.count("*")))


@query("SELECT o_orderkey AS number, s AS status, CAST(CASE s WHEN 'CI-FAIL' THEN 1 WHEN 'READY' THEN 3 ELSE 6 END AS INT) AS rank FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CI-FAIL' WHEN o_orderkey % 3 = 1 THEN 'READY' ELSE 'STALE' END AS s FROM orders)")
def triage(spark, d):
    k = F.col("o_orderkey") % 3
    return impact.triage(load(spark, d, "orders")[0].select(F.col("o_orderkey").alias("number"), F.when(k == 0, "CI-FAIL").when(k == 1, "READY").otherwise("STALE").alias("status"))).withColumn("rank", F.col("rank").cast("int"))


@query("SELECT o_orderkey AS number, o_orderpriority AS title, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def request_list(spark, d):
    return answers.request_list(load(spark, d, "orders")[0].select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at")))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(MIN(ts)) AS start, epoch_us(MAX(ts)) AS last, COUNT(*) AS changes FROM g GROUP BY user_id, k")
def quiet_bursts(spark, d):
    """The debounce rule over all events: a burst of a user ends once nothing came for six hours."""
    e = load(spark, d, "events")[0].withColumn("ts", F.col("ts").cast("timestamp"))
    return quiet_groups(e, "6 hours", "1 day", "user_id").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "changes")


# --- views


@query(DEGREE + " SELECT community, id, label, degree FROM nodes JOIN degree USING (id)", True)
def community_listing(spark, d):
    return answers.community_members(*supply_graph(spark, d))


@query(""", two AS (SELECT source a FROM edges UNION ALL SELECT target FROM edges), g AS (SELECT id, label, community, COUNT(a) n FROM nodes LEFT JOIN two ON id = a GROUP BY 1, 2, 3), h AS (SELECT community, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY community ORDER BY n DESC, id) r FROM g) WHERE r = 1)
SELECT community, (SELECT COUNT(*) FROM nodes n WHERE n.community = h.community) AS size, CASE WHEN COUNT(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || CAST(community AS VARCHAR) || ')' ELSE label END AS name FROM h""", True)
def display_names(spark, d):
    return answers.display_names(*supply_graph(spark, d))


@query(", k AS (SELECT id AS node, community FROM nodes UNION ALL SELECT label, community FROM nodes) SELECT node, 'group ' || CAST(MIN(community) AS VARCHAR) AS name FROM k GROUP BY node", True)
def home_names(spark, d):
    n = supply_graph(spark, d)[0]
    names = n.select("community").distinct().select("community", F.concat(F.lit("group "), F.col("community").cast("string")).alias("name"))
    return answers.home_names(n, names)


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, p_size % 7 AS community FROM part")
def inverted_communities(spark, d):
    g = load(spark, d, "part")[0].groupBy((F.col("p_size") % 7).alias("community")).agg(F.collect_list(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("nodes"))
    return answers.members_of(g)


@query(" SELECT community, string_agg(label, '|' ORDER BY r) AS labels FROM (SELECT community, label, ROW_NUMBER() OVER (PARTITION BY community ORDER BY id) r FROM nodes) WHERE r <= 4 GROUP BY 1", True)
def first_labels(spark, d):
    return answers.first_labels(supply_graph(spark, d)[0]).select("community", F.array_join("labels", "|").alias("labels"))


@query(DEGREE + ", e AS (SELECT community, label, MIN(-degree) AS m, arg_min(id, (-degree, id)) AS i FROM nodes JOIN degree USING (id) GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY community ORDER BY m, i) AS r FROM e) SELECT community, CAST(community AS VARCHAR) || ': ' || string_agg(label, ', ' ORDER BY r) AS line FROM r WHERE r <= 12 GROUP BY 1", True)
def prompt_lines(spark, d):
    n, e = supply_graph(spark, d)
    return answers.prompt_lines(n, e, n.where("false"))


@query(DEGREE + """, g AS (SELECT id FROM nodes JOIN degree USING (id) WHERE label <> regexp_extract(source_file, '[^/]+$') ORDER BY degree DESC, id LIMIT 10), x AS (SELECT source AS id, 'out' AS direction, target AS other, MIN(relation) AS relation FROM edges WHERE source IN (SELECT id FROM g) GROUP BY 1, 3 UNION ALL SELECT target, 'in', source, MIN(relation) FROM edges WHERE target IN (SELECT id FROM g) GROUP BY 1, 3),
r AS (SELECT x.*, CAST(ROW_NUMBER() OVER (PARTITION BY x.id, direction ORDER BY degree DESC, other) AS INT) AS rank FROM x JOIN degree d ON d.id = other) SELECT id, direction, rank, other, relation FROM r WHERE rank <= 20""", True)
def god_articles(spark, d):
    n, e = supply_graph(spark, d)
    return answers.god_articles(n, e, topology.god_nodes(n, e))


@query("WITH v AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node, CASE p_size % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'contested' ELSE 'tentative' END AS verdict, p_retailprice AS score FROM part) SELECT verdict, rank, node, score FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY verdict ORDER BY score DESC, node) AS INT) AS rank FROM v) WHERE rank <= 10")
def learning_lines(spark, d):
    k = F.col("p_size") % 3
    return answers.learning_lines(load(spark, d, "part")[0].select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.when(k == 0, "preferred").when(k == 1, "contested: useful").otherwise("tentative").alias("verdict"), F.col("p_retailprice").alias("score")))


@query(" SELECT source_file, COUNT(*) AS n FROM nodes GROUP BY 1", True)
def nodes_by_file(spark, d):
    return answers.by_file(supply_graph(spark, d)[0])


@query(SCORES + " SELECT id, label, ROUND(score, 6) AS score FROM scored WHERE score > 0", True)
def indexed_scores(spark, d):
    """The scores of a scan, from the candidates of the trigram index."""
    n = supply_graph(spark, d)[0]
    return answers.score_by_index(n, answers.trigrams(n), ["supplier", "customer"]).select("id", "label", F.round("score", 6).alias("score"))


@query(" SELECT id FROM nodes WHERE contains(lower(label), 'customer#00000001') OR contains(lower(id), 'region:3')", True)
def index_candidates(spark, d):
    n = supply_graph(spark, d)[0]
    found = answers.candidates(n, answers.trigrams(n), ["customer#00000001", "region:3"], 1.0)
    both = rank.searchable(n).join(found, "id", "left_semi")
    return both.where(F.col("norm").contains("customer#00000001") | F.lower("id").contains("region:3")).select("id")


@query("SELECT 0 AS pos, 'Supplier#000000001 --based_in-- ' || n_name AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1 UNION ALL SELECT 1, n_name || ' --in_region-- ' || r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 1")
def path_answer(spark, d):
    """From the first supplier to its region, by their names."""
    n, e = supply_graph(spark, d)
    supplier, nation, region = load(spark, d, "supplier", "nation", "region")
    one = supplier.where("s_suppkey = 1").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).first()
    return answers.path_answer(n, e.where("relation in ('based_in', 'in_region')"), one.s_name, one.r_name).select("pos", "line")


_KINDS = {"calls": ["supplier", "code"], "places": ["nation", "asia", "region", "country"]}


@query(""", c AS (SELECT community, SUM(len(regexp_extract_all(lower(label), 'supplier')) + len(regexp_extract_all(lower(label), 'code'))) AS calls, SUM(len(regexp_extract_all(lower(label), 'nation')) + len(regexp_extract_all(lower(label), 'asia')) + len(regexp_extract_all(lower(label), 'region')) + len(regexp_extract_all(lower(label), 'country'))) AS places FROM nodes GROUP BY 1)
SELECT community, CASE WHEN GREATEST(calls, places) < 2 THEN 'other' WHEN calls >= places THEN 'calls' ELSE 'places' END AS section, CAST(GREATEST(calls, places) AS BIGINT) AS score FROM c""", True)
def section_archetypes(spark, d):
    return sections.archetypes(supply_graph(spark, d)[0], _KINDS)


@query(", l AS (SELECT source AS id, 1 AS d FROM edges UNION ALL SELECT target, -1 FROM edges) SELECT id, CAST(SUM(d) AS BIGINT) AS lead FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", True)
def entry_points(spark, d):
    return sections.entries(supply_graph(spark, d)[1])


@query("SELECT 'docs/en' AS root")
def common_root(spark, d):
    docs = load(spark, d, "documents")[0].select(F.concat(F.lit("docs/en/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return spark.createDataFrame([(sections.common_root(docs.union(spark.createDataFrame([("docs/en/a/b/c",)], "path string"))),)], "root string")


# --- scalar functions


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_brand || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')), ' ', '_', 'g') AS slug, trim(regexp_replace(lower(p_brand || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')) AS norm, lower(p_brand) AS callable FROM part")
def label_forms(spark, d):
    x = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return load(spark, d, "part")[0].select("p_partkey", X.make_slug(x).alias("slug"), X.normal_label(x).alias("norm"), X.callable_name(F.concat(F.lit("."), "p_brand", F.lit("()"))).alias("callable"))


@query("SELECT p_partkey, ROUND(jaro_similarity(lower(p_name), lower(p_brand || ' ' || p_type)), 9) AS jaro, ROUND(jaro_winkler_similarity(lower(p_name), lower(p_brand || ' ' || p_type)), 9) AS winkler, CAST(damerau_levenshtein(lower(p_name), lower(p_brand || ' ' || p_type)) AS INT) AS damerau FROM part")
def label_likeness(spark, d):
    a, b = F.lower("p_name"), F.lower(F.concat_ws(" ", "p_brand", "p_type"))
    return load(spark, d, "part")[0].select("p_partkey", F.round(X.jaro(a, b), 9).alias("jaro"), F.round(X.jaro_winkler(a, b), 9).alias("winkler"), X.damerau(a, b).alias("damerau"))


@query(r"SELECT p_partkey, list_sort(list_transform(regexp_extract_all(p_name, '[0-9]+'), lambda x: CAST(CAST(x AS HUGEINT) AS VARCHAR))) <> list_sort(list_transform(regexp_extract_all(p_brand, '[0-9]+'), lambda x: CAST(CAST(x AS HUGEINT) AS VARCHAR))) AS differ FROM part")
def label_numbers(spark, d):
    return load(spark, d, "part")[0].select("p_partkey", X.numbers_apart(F.col("p_name"), F.col("p_brand")).alias("differ"))


@query("SELECT \"key\" AS k, 'edge:v1:' || sha256(relation || chr(31) || source_file || chr(31) || context) AS stable FROM edges", True)
def edge_keys(spark, d):
    return supply_graph(spark, d)[1].select(F.col("key").alias("k"), X.edge_key(F.col("relation"), F.col("source_file"), F.col("context")).alias("stable"))


_ESC = "replace(replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\', '\\\\'), "


@query(f"SELECT doc_id, {_ESC}'''', '\\''') AS cypher, '\"' || regexp_replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '[\\x00-\\x1f\\x7f]', ' ', 'g') || '\"' AS yaml, substring(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256) AS shown FROM documents")
def escaped_texts(spark, d):
    t = F.col("text")
    return load(spark, d, "documents")[0].select("doc_id", X.cypher_text(t).alias("cypher"), X.yaml_text(t).alias("yaml"), X.safe_label(t).alias("shown"))


@query("SELECT doc_id, sha256(text || chr(0) || 'docs/' || CAST(doc_id AS VARCHAR) || '.md') AS hash, text AS body FROM documents")
def content_hashes(spark, d):
    """Documents under front matter that isn't part of the hash."""
    framed = F.concat(F.lit("---\ntitle: x\n---\n"), "text")
    path = F.concat(F.lit("Docs/"), F.col("doc_id").cast("string"), F.lit(".MD"))
    return load(spark, d, "documents")[0].select("doc_id", prepare.content_hash(framed, path).alias("hash"), X.body(framed).alias("body"))


@query("SELECT page_id, 'a/b/' || CAST(page_id AS VARCHAR) AS clean, CASE page_id % 4 WHEN 0 THEN 'env_file' WHEN 1 THEN 'key_file' WHEN 2 THEN 'credential_directory' END AS reason, CASE WHEN page_id % 2 = 0 THEN 'a_b_' || CAST(page_id AS VARCHAR) ELSE '_CON' END AS stem FROM pages")
def path_rules(spark, d):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    odd = F.when(k == 0, ".env.local").when(k == 1, F.concat(F.lit("x/"), i, F.lit(".pem"))).when(k == 2, F.concat(F.lit("home/.ssh/"), i)).otherwise(F.concat(F.lit("src/"), i, F.lit(".py")))
    return load(spark, d, "pages")[0].select("page_id", P.clean_path(F.concat(F.lit("./a\\b//"), i)).alias("clean"), P.credential_path(odd).alias("reason"), P.safe_stem(F.when(k % 2 == 0, F.concat(F.lit("a:b/"), i)).otherwise("CON")).alias("stem"))


@query(" SELECT id, CASE WHEN file_type = 'code' THEN 'symbol' ELSE file_type END AS kind, trim(regexp_replace(regexp_replace(label, '[_-]+', ' ', 'g'), ' +', ' ', 'g')) AS name FROM nodes", True)
def node_kinds(spark, d):
    plain = supply_graph(spark, d)[0]
    return plain.select("id", answers.node_kind(F.concat(F.col("label"), F.lit("#x")), F.col("source_file"), F.col("file_type")).alias("kind"), answers.human_label(F.concat(F.lit("."), F.regexp_replace("label", " ", "_"), F.lit("()"))).alias("name"))


@query("SELECT doc_id, ROUND((length(text) * 3.0 + n_chars * 15.0) / 1e6, 9) AS cost FROM documents")
def token_costs(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", F.round(answers.token_cost(F.length("text"), F.col("n_chars"), 3.0, 15.0), 9).alias("cost"))


@query("SELECT doc_id, '&lt;untrusted_source>' || regexp_replace(text, '<(/?)\\s*(untrusted[_-]?source|system|assistant)\\b', '&lt;\\1\\2', 'gi') AS text FROM documents")
def neutral_texts(spark, d):
    return load(spark, d, "documents")[0].select("doc_id", prepare.neutralised(F.concat(F.lit("<untrusted_source>"), "text")).alias("text"))


@query("SELECT doc_id AS line, CASE WHEN doc_id % 2 = 0 THEN 'noqa' ELSE 'type: ignore' END AS kind FROM documents WHERE doc_id % 4 <> 0")
def suppression_sites(spark, d):
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "").when(k == 2, "  # NOQA").otherwise(" #  type:  ignore[x]")
    lines = load(spark, d, "documents")[0].select(F.lit("a.py").alias("path"), F.col("doc_id").alias("line"), F.concat(F.lit("x = 1"), mark).alias("text"))
    return answers.suppressions(lines).select("line", "kind")


@query("SELECT conv_id, turn, 'q' || CAST(turn AS VARCHAR) AS question, CASE WHEN turn % 2 = 0 THEN 'useful' ELSE 'dead_end' END AS outcome, 'n1,n' || CAST(conv_id AS VARCHAR) AS nodes, epoch_us(TIMESTAMP '2024-01-02 00:00:00') AS date FROM conversations")
def memory_documents(spark, d):
    c = load(spark, d, "conversations")[0]
    text = F.concat(F.lit('---\ndate: 2024-01-02\nquestion: "q'), F.col("turn").cast("string"), F.lit('"\noutcome: '), F.when(F.col("turn") % 2 == 0, "useful").otherwise("dead_end"), F.lit('\nsource_nodes: ["n1", "n'), F.col("conv_id").cast("string"), F.lit('"]\n---\n'), "text")
    m = feedback.parse_memory(text)
    return c.select("conv_id", "turn", m["question"].alias("question"), m["outcome"].alias("outcome"), F.array_join(m["source_nodes"], ",").alias("nodes"), F.unix_micros(m["date"]).alias("date"))


_PACK = """WITH RECURSIVE f AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS p, CAST(FLOOR((LEAST(length(text), 20000) + 160) / 4.0) AS BIGINT) AS t, ROW_NUMBER() OVER (PARTITION BY source ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS r FROM documents),
g AS (SELECT source, p, t, r, 0 AS chunk, t AS used FROM f WHERE r = 1 UNION ALL SELECT f.source, f.p, f.t, f.r, CASE WHEN g.used + f.t > 20000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.used + f.t > 20000 THEN f.t ELSE g.used + f.t END FROM g JOIN f ON f.source = g.source AND f.r = g.r + 1)
SELECT source || '/' || p AS path, source AS folder, CAST(chunk AS INT) AS chunk, t AS tokens FROM g"""


@query(_PACK)
def token_packing(spark, d):
    docs = load(spark, d, "documents")[0]
    return prepare.pack(docs.select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), prepare.token_estimate(F.col("text")).alias("tokens"), F.lit(False).alias("is_image")), 20_000)


@query(" SELECT id, 'group ' || CAST(community AS VARCHAR) AS name FROM nodes WHERE file_type = 'concept'", True)
def kept_ids(spark, d):
    """Communities found again under other numbers get their old ones back."""
    n = supply_graph(spark, d)[0].where("file_type = 'concept'").select("id", "community")
    new = n.select("id", (100 - F.col("community")).alias("community"))
    return community.remap(new, n).select("id", F.concat(F.lit("group "), F.col("community").cast("string")).alias("name"))
