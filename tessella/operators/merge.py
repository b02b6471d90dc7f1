"""Building, merging, comparing and pruning graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import width

from .topology import missing_ends

FILE_TYPES = {"code": "code source script", "document": "document doc documentation markdown text", "paper": "paper article publication", "image": "image figure diagram", "rationale": "rationale reason"}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


def file_type(value: Column) -> Column:
    """The known name of a file type; unknown or null: concept."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(*(F.when(v.isin(*words.split()), k) for k, words in FILE_TYPES.items()), F.lit("concept"))


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, subject of every breach: missing fields, unknown names, duplicate ids, dangling ends."""
    n, e = F.col("id"), F.concat_ws(" -> ", F.coalesce("source", F.lit("?")), F.coalesce("target", F.lit("?")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    found = [nodes.where(blank(c)).select(F.lit(f"node without {c}").alias("rule"), F.coalesce(n, F.lit("?")).alias("subject")) for c in ("id", "label", "file_type", "source_file")]
    found.append(nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate node id").alias("rule"), F.col("id").alias("subject")))
    found += [edges.where(blank(c)).select(F.lit(f"edge without {c}").alias("rule"), e.alias("subject")) for c in ("source", "target", "relation", "confidence")]
    found.append(edges.where(~F.col("confidence").isin(*CONFIDENCES)).select(F.lit("unknown confidence").alias("rule"), e.alias("subject")))
    lost = missing_ends(nodes, edges)
    for end in ("source", "target"):
        gone = edges.where(~blank(end)).join(lost.select(F.col("id").alias(end)), end, "left_semi")
        found.append(gone.select(F.lit(f"dangling {end}").alias("rule"), F.col(end).alias("subject")))
    return combine(*found)


def first_edges(edges: DataFrame, pos: str = "pos") -> DataFrame:
    """One edge per (source, target, relation): the first."""
    return edges.groupBy("source", "target", "relation").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("source", "target", "relation")]), F.col(pos)).alias("r")).select("source", "target", "relation", "r.*")


def last_nodes(nodes: DataFrame, pos: str = "pos") -> DataFrame:
    """One node per id: the last one's attributes at the first one's position; null ids go."""
    rest = [c for c in nodes.columns if c not in ("id", pos)]
    out = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), F.col(pos)).alias("r"), F.min(pos).alias(pos))
    return out.select("id", *(F.col(f"r.{c}").alias(c) for c in rest), pos)


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def unique_aliases(nodes: DataFrame, alias: Column) -> DataFrame:
    """alias, id for the aliases that one node alone claims; contested ones are skipped, never guessed."""
    a = nodes.select(alias.alias("alias"), "id").where("alias is not null and alias <> ''").groupBy("alias").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return a.where("id = other").select("alias", "id")


def resolve_ends(nodes: DataFrame, edges: DataFrame, normal: Column | None = None) -> DataFrame:
    """Edges whose ends are ids, exact unique labels, or unique normalised ones; the rest as they are."""
    exact = unique_aliases(nodes, F.col("label"))
    loose = unique_aliases(nodes, normal if normal is not None else F.lower(F.trim("label")))
    ids = nodes.select(F.col("id").alias("known")).distinct()
    out = edges
    for end in ("source", "target"):
        key = F.lower(F.trim(F.col(end)))
        out = out.withColumn("_k", key).join(ids, F.col(end) == F.col("known"), "left").join(exact.select(F.col("alias").alias("_a"), F.col("id").alias("_e")), F.col(end) == F.col("_a"), "left").join(loose.select(F.col("alias").alias("_b"), F.col("id").alias("_l")), F.col("_k") == F.col("_b"), "left")
        out = out.withColumn(end, F.coalesce("known", "_e", "_l", end)).drop("_k", "known", "_a", "_e", "_b", "_l")
    return out.select(*edges.columns)


def remap_ids(edges: DataFrame, remap: DataFrame, columns: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Replaces ids by a table (old, new)."""
    out = edges
    for c in columns:
        out = out.join(remap.select(F.col("old").alias("_o"), F.col("new").alias("_n")), F.col(c) == F.col("_o"), "left").withColumn(c, F.coalesce("_n", c)).drop("_o", "_n")
    return out.select(*edges.columns)


def ghost_merges(nodes: DataFrame) -> DataFrame:
    """old, new: a node not from the syntax tree that shares base name and label with exactly one that is."""
    base = F.element_at(F.split(F.coalesce("source_file", F.lit("")), "/"), -1)
    n = nodes.select("id", base.alias("file"), F.lower(F.trim("label")).alias("l"), (F.coalesce("origin", F.lit("")) == "ast").alias("ast"))
    sure = n.where("ast").groupBy("file", "l").agg(F.min("id").alias("new"), F.max("id").alias("other")).where("new = other").select("file", "l", "new")
    return n.where("not ast and file <> ''").join(sure, ["file", "l"]).where("id <> new").select(F.col("id").alias("old"), "new")


def salted_keys(edges: DataFrame, pos: str = "pos") -> DataFrame:
    """Parallel edges of one key made distinct: all but the first get a hash of their content behind it."""
    w = Window.partitionBy("source", "target", "key").orderBy(pos)
    rest = [c for c in edges.columns if c not in ("source", "target", "key", pos)]
    salt = F.concat("key", F.lit(":alt:"), F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest), F.col("_n").cast("string")), 256))
    return edges.withColumn("_n", F.row_number().over(w)).withColumn("key", F.when(F.col("_n") > 1, salt).otherwise(F.col("key"))).drop("_n")


def replace_sources(old: DataFrame, new: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Incremental merge: records of re-read or pruned sources go, the new ones come; records without a source stay."""
    gone = new.select("source_file").where("source_file is not null and source_file <> ''")
    if pruned is not None:
        gone = gone.union(pruned.select("source_file"))
    return combine(old.join(gone.distinct(), "source_file", "left_anti").select(*old.columns), new)


def evict(nodes: DataFrame, fresh: DataFrame, evicted: DataFrame, reread: DataFrame, full: bool = False) -> DataFrame:
    """Old nodes that an incremental rebuild keeps, by three predicates over the source sets."""
    n = nodes.join(fresh.select("id").distinct(), "id", "left_anti").join(evicted.select("source_file").distinct(), "source_file", "left_anti")
    ast = F.coalesce("origin", F.lit("")) == "ast"
    if full:
        return n.where(~ast).select(*nodes.columns)
    r = reread.select("source_file").distinct().withColumn("_r", F.lit(True))
    return n.join(r, "source_file", "left").where(~(ast & F.coalesce("_r", F.lit(False)))).select(*nodes.columns)


def hyperedges(records: DataFrame, nodes: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """id, label, relation, nodes: members remapped, live, distinct and sorted; at least two, or the record goes.

    A record without an id gets one from its content.
    """
    keys = ["id", "label", "relation"]
    m = records.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.explode("nodes").alias("m"))
    if remap is not None:
        m = m.join(remap.select(F.col("old").alias("m"), "new"), "m", "left").withColumn("m", F.coalesce("new", "m")).drop("new")
    m = m.join(nodes.select(F.col("id").alias("m")).distinct(), "m", "left_semi")
    g = m.groupBy("_row", *keys).agg(F.array_sort(F.collect_set("m")).alias("nodes")).where(F.size("nodes") >= 2)
    own = F.concat(F.lit("hyperedge:v1:"), F.sha2(F.concat_ws("\u001f", F.coalesce("label", F.lit("")), F.coalesce("relation", F.lit("")), F.array_join("nodes", "\u001e")), 256))
    return g.select(F.coalesce("id", own).alias("id"), "label", "relation", "nodes")


def prune(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.join(gone.select("id").distinct(), "id", "left_anti").select(*nodes.columns)
    return kept, live_edges(kept, edges)


def graph_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """change, kind, identity: what was added and removed, by id and by (source, target, relation, key)."""
    node = lambda df: df.select("id").distinct().withColumnRenamed("id", "identity")
    edge = lambda df: df.select(F.concat_ws(" | ", "source", "target", F.coalesce("relation", F.lit("")), F.coalesce("key", F.lit(""))).alias("identity")).distinct()
    out = []
    for kind, f, a, b in (("node", node, old_nodes, new_nodes), ("edge", edge, old_edges, new_edges)):
        out.append(f(b).join(f(a), "identity", "left_anti").select(F.lit("added").alias("change"), F.lit(kind).alias("kind"), "identity"))
        out.append(f(a).join(f(b), "identity", "left_anti").select(F.lit("removed").alias("change"), F.lit(kind).alias("kind"), "identity"))
    return combine(*out)


def same_topology(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether two record tables are equal as multisets over the columns."""
    side = lambda df, sign: df.select(*columns, F.lit(sign).alias("_s"))
    both = side(a, 1).union(side(b, -1))
    counts = both.repartition(width(both.sparkSession), *columns).groupBy(*columns).agg(F.sum("_s").alias("_n"))
    return not counts.where("_n <> 0").take(1)


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A hash of a table as a multiset: a count and a sum of row hashes, so nothing is sorted or gathered."""
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(s), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)).cast("decimal(38,0)")).alias(f"h{s}") for s in range(2))).first()
    import hashlib

    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def three_way(base: DataFrame, current: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merged records, and conflicts (keys, field). Per field: equal sides win, else the side that changed; both changed is a conflict,
    and the current value stays. A record deleted on one side and unchanged on the other goes; deleted and changed is a conflict."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, *(F.col(f).alias(f"{p}_{f}") for f in fields), F.lit(True).alias(f"{p}_here"))

    j = side(base, "b").join(side(current, "c"), keys, "full_outer").join(side(other, "o"), keys, "full_outer")
    b, c, o = (F.coalesce(F.col(f"{p}_here"), F.lit(False)) for p in "bco")
    j = j.withColumn("_b", b).withColumn("_c", c).withColumn("_o", o)
    same = lambda x, y: reduce(lambda p, q: p & q, (F.col(f"{x}_{f}").eqNullSafe(F.col(f"{y}_{f}")) for f in fields), F.lit(True))
    gone = (~F.col("_c") & ~F.col("_o")) | (F.col("_b") & ~F.col("_c") & F.col("_o") & same("b", "o")) | (F.col("_b") & F.col("_c") & ~F.col("_o") & same("b", "c"))
    deleted = F.col("_b") & ((~F.col("_c") & F.col("_o") & ~same("b", "o")) | (F.col("_c") & ~F.col("_o") & ~same("b", "c")))

    def value(f: str) -> Column:
        x, y, z = (F.col(f"{p}_{f}") for p in "bco")
        return F.when(~F.col("_c"), z).when(~F.col("_o"), y).when(y.eqNullSafe(z), y).when(F.col("_b") & y.eqNullSafe(x), z).otherwise(y)

    def clash(f: str) -> Column:
        x, y, z = (F.col(f"{p}_{f}") for p in "bco")
        return F.col("_c") & F.col("_o") & ~y.eqNullSafe(z) & ~(F.col("_b") & (y.eqNullSafe(x) | z.eqNullSafe(x)))

    # a record deleted here but changed there is a conflict in which the current state, the deletion, stays
    merged = j.where(~gone & ~(deleted & ~F.col("_c"))).select(*keys, *(value(f).alias(f) for f in fields))
    named = F.array_compact(F.array(*(F.when(clash(f), f) for f in fields), F.when(deleted, "deleted")))
    return merged, j.select(*keys, F.explode(named).alias("field"))


def with_repo(df: DataFrame, tag: str, columns: list[str]) -> DataFrame:
    """Ids moved into a repository's name space; nodes keep their own as local_id."""
    out = df.withColumn("local_id", F.col("id")) if "id" in df.columns else df
    for c in columns:
        out = out.withColumn(c, F.concat(F.lit(f"{tag}::"), F.col(c)))
    return out.withColumn("repo", F.lit(tag))


def compose(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Graphs side by side in their name spaces; nodes without a source file are shared by label, with their owners."""
    nodes = combine(*(with_repo(n, t, ["id"]) for t, (n, _) in parts.items()))
    edges = combine(*(with_repo(e, t, ["source", "target"]) for t, (_, e) in parts.items()))
    shared = nodes.where("coalesce(source_file, '') = ''").groupBy("label").agg(F.min("id").alias("new"), F.array_sort(F.collect_set("repo")).alias("owners"))
    owned = nodes.join(shared, "label", "left").withColumn("_new", F.when(F.coalesce("source_file", F.lit("")) == "", F.col("new")).otherwise(F.col("id")))
    remap = owned.where("_new <> id").select(F.col("id").alias("old"), F.col("_new").alias("new"))
    kept = owned.where("_new = id").withColumn("owners", F.when(F.coalesce("source_file", F.lit("")) == "", F.col("owners")).otherwise(F.array("repo")))
    return kept.drop("new", "_new"), remap_ids(edges, remap)


def detach(nodes: DataFrame, tag: str) -> DataFrame:
    """A repository's nodes out: shared ones lose it as an owner and go with their last one."""
    left = F.array_remove("owners", tag)
    return nodes.where(F.size(left) > 0).withColumn("owners", left)


def unresolved(nodes: DataFrame, **channels: DataFrame) -> DataFrame:
    """channel, id of every reference, in any of the given one-column tables, to a node that isn't there."""
    out = [df.select(F.lit(name).alias("channel"), F.col(df.columns[0]).alias("id")).where("id is not null").distinct() for name, df in channels.items()]
    return combine(*out).join(nodes.select("id").distinct(), "id", "left_anti").select("channel", "id")


def shrink_guard(old: DataFrame, new: DataFrame, force: bool = False, rebuilt: DataFrame | None = None) -> bool:
    """Whether a new node table may replace an old one: never by nothing, by fewer only if forced or lost from rebuilt sources alone."""
    n, m = old.count(), new.count()
    if n and not m:
        return False
    if m >= n or force:
        return True
    if rebuilt is None:
        return False
    lost = old.join(new.select("id"), "id", "left_anti")
    return not lost.join(rebuilt.select("source_file").distinct(), "source_file", "left_anti").take(1)


# --- classes of graphs


def to_class(edges: DataFrame, kind: str, pos: str = "pos") -> DataFrame:
    """Edges of a multigraph as a simple graph (unordered pairs), a digraph (ordered pairs) or unchanged; the last record of a pair wins."""
    if kind == "multidigraph":
        return edges
    if kind not in ("simple", "digraph"):
        raise ValueError("kind is simple, digraph or multidigraph")
    ends = ["source", "target"]
    keys = [F.least(*ends).alias("_a"), F.greatest(*ends).alias("_b")] if kind == "simple" else [F.col("source").alias("_a"), F.col("target").alias("_b")]
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*edges.columns), F.col(pos)).alias("r")).select("r.*")


def least_lossy(kinds: list[str]) -> str:
    """The class that holds all the given ones."""
    order = ["simple", "digraph", "multidigraph"]
    return order[max((order.index(k) for k in kinds), default=0)]


def lifted(edges: DataFrame) -> DataFrame:
    """A simple graph's edges in their true direction, with a key; an edge without one fails, as its direction would be a guess."""
    known = F.col("true_src").isNotNull() & F.col("true_tgt").isNotNull()
    sure = lambda c: F.when(known, F.col(c)).otherwise(F.raise_error(F.lit("edge without a recorded direction")))
    return edges.withColumn("source", sure("true_src")).withColumn("target", sure("true_tgt")).withColumn("key", F.coalesce("key", F.concat_ws("|", "relation", "source_file")))


def keyed_first(edges: DataFrame, pos: str = "pos") -> DataFrame:
    """Records equal but for key, score and origin: a keyed one replaces the keyless, each key once."""
    rest = [c for c in edges.columns if c not in ("key", "confidence_score", "origin", pos)]
    h = edges.withColumn("_h", F.sha2(F.to_json(F.struct(*rest)), 256))
    keyed = h.where("key is not null").select("_h").distinct()
    w = Window.partitionBy("_h", "key").orderBy(pos)
    kept = h.where("key is not null").unionByName(h.where("key is null").join(keyed, "_h", "left_anti").select(*h.columns))
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_h", "_r")


def checked_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with live ends; a dangling edge from the syntax tree goes, any other fails the job."""
    ids = nodes.select("id").distinct()
    j = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    live = F.coalesce("_s", F.lit(False)) & F.coalesce("_t", F.lit(False))
    ast = F.coalesce("origin", F.lit("")) == "ast"
    return j.where(F.when(live, True).when(ast, False).otherwise(F.raise_error(F.concat(F.lit("dangling edge "), "source", F.lit(" -> "), "target")).cast("boolean"))).select(*edges.columns)


def renamed_nodes(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """old, new: an old syntax-tree id and the fresh one of the same source, label, kind and place, else of the same without the place; unique ones only."""
    cols = ["source_file", "label", "file_type"]
    gone = old.join(fresh.select("id"), "id", "left_anti").select("id", *cols, "source_location")

    def match(left: DataFrame, keys: list[str]) -> DataFrame:
        a = left.groupBy(*keys).agg(F.min("id").alias("old"), F.max("id").alias("z")).where("old = z").drop("z")
        b = fresh.groupBy(*keys).agg(F.min("id").alias("new"), F.max("id").alias("z")).where("new = z").drop("z")
        return a.join(b, keys).select("old", "new")

    first = match(gone, [*cols, "source_location"])
    rest = gone.join(first.select(F.col("old").alias("id")), "id", "left_anti")
    return first.union(match(rest, cols))


def without_pair(edges: DataFrame, a: str, b: str) -> DataFrame:
    """All parallel edges between two nodes removed."""
    return edges.where(~(((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a))))


def between(edges: DataFrame, a: str, b: str, directed: bool = False) -> DataFrame:
    e = (F.col("source") == a) & (F.col("target") == b)
    return edges.where(e if directed else e | ((F.col("source") == b) & (F.col("target") == a)))


def merged_metadata(named: dict[str, dict]) -> tuple[dict, dict]:
    """Metadata of several graphs as one, and what conflicts: equal values stay, lists unite in order, maps merge key by key."""
    out: dict = {}
    clash: dict = {}
    for name, meta in named.items():
        for k, v in meta.items():
            if k not in out:
                out[k] = v
            elif isinstance(out[k], dict) and isinstance(v, dict):
                inner, bad = merged_metadata({"a": out[k], name: v})
                out[k] = inner
                clash |= {f"{k}.{x}": y for x, y in bad.items()}
            elif isinstance(out[k], list) and isinstance(v, list):
                out[k] = out[k] + [x for x in v if x not in out[k]]
            elif out[k] != v:
                clash[k] = {"kept": out[k], name: v}
    return out, clash


def strict_violations(nodes: DataFrame, edges: DataFrame, relations: list[str], node_keys: DataFrame | None = None) -> DataFrame:
    """rule, subject under the strict contract for model-made fragments: known file types and relations, scores in range, no unknown keys."""
    known = [*FILE_TYPES, "concept"]
    out = [nodes.where(~F.coalesce(F.col("file_type").isin(*known), F.lit(False))).select(F.lit("unknown file type").alias("rule"), F.col("id").alias("subject"))]
    subject = F.concat_ws(" -> ", "source", "target")
    out.append(edges.where(~F.coalesce(F.col("relation").isin(*relations), F.lit(False))).select(F.lit("unknown relation").alias("rule"), subject.alias("subject")))
    out.append(edges.where("confidence_score is not null and not (confidence_score between 0 and 1)").select(F.lit("score out of range").alias("rule"), subject.alias("subject")))
    if node_keys is not None:
        out.append(node_keys.select(F.lit("unknown key").alias("rule"), F.col(node_keys.columns[0]).alias("subject")))
    return combine(*out, violations(nodes, edges))
