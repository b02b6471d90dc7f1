"""Resolution of calls and references by unique-candidate joins. Ambiguity is skipped, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name, is_test
from tessella.functions.text import callable_name


def unique_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, relation, confidence, confidence_score of calls whose name one code node alone has; known edges left out.

    ``calls``: caller, callee, is_member_call, source_file. Member calls have no receiver type here and are skipped.
    """
    index = nodes.where("file_type = 'code'").select(callable_name(F.col("label")).alias("name"), "id").where("name <> ''").groupBy("name").agg(F.min("id").alias("target"), F.max("id").alias("z")).where("target = z")
    hit = calls.where("not coalesce(is_member_call, false)").join(index, callable_name(F.col("callee")) == F.col("name")).where("caller <> target")
    new = hit.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation")).distinct().join(edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    return new.withColumn("confidence", F.lit("INFERRED")).withColumn("confidence_score", F.lit(0.8))


def nearest_candidates(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target for names with several candidates: tests call tests and others others, then the same file, the same folder,
    the one longest common prefix; a tie at the best level gives nothing.

    Candidates of a name are summed up by file, folder and each leading folder, so a call meets as many rows as its path has
    segments, not all candidates. The smallest, the largest and whether there are more tell if one is left without the caller.
    """
    cand = nodes.where("file_type = 'code'").select(callable_name(F.col("label")).alias("name"), F.col("id").alias("target"), F.coalesce("source_file", F.lit("")).alias("file")).where("name <> '' and target is not null").distinct()
    sites = calls.select("caller", callable_name(F.col("callee")).alias("name"), F.coalesce("source_file", F.lit("")).alias("site")).where("caller is not null and name <> ''")

    def levels(path: Column) -> Column:
        parts = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
        leading = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("key")))
        near = F.array(F.struct(F.lit(1_000_000).alias("level"), path.alias("key")), F.struct(F.lit(500_000).alias("level"), F.array_join(parts, "/").alias("key")))
        return F.concat(near, leading)

    each = cand.groupBy("name", "file").agg(F.min("target").alias("lo"), F.max("target").alias("hi"), F.count("*").alias("n"))
    ends = each.select("name", "file", F.explode(F.array("lo", "hi")).alias("target"), (F.col("n") > 2).alias("more"))
    # a test's call sees all candidates, any other only those outside tests
    seen = ends.select("name", "file", "target", "more", F.explode(F.when(is_test(F.col("file")), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("test"))
    group = seen.select("name", "test", "target", "more", F.inline(levels(F.col("file")))).groupBy("name", "test", "level", "key").agg(F.min("target").alias("lo"), F.max("target").alias("hi"), F.countDistinct("target").alias("n"), F.max("more").alias("more"))
    asked = sites.select("name", "site").distinct()
    asked = asked.select("name", "site", is_test(F.col("site")).alias("test"), F.inline(levels(F.col("site"))))
    met = asked.join(group, ["name", "test", "level", "key"]).groupBy("name", "site").agg(F.sort_array(F.collect_list(F.struct("level", "lo", "hi", F.when(F.col("more"), 3).otherwise(F.least("n", F.lit(3))).alias("n"))), asc=False).alias("near"))  # a row a level
    left = F.element_at(F.filter("near", lambda x: (x["n"] > 1) | (x["lo"] != F.col("caller"))), 1)
    two = F.col("m.n") == 2
    lo = F.when(two & (F.col("m.lo") == F.col("caller")), F.col("m.hi")).otherwise(F.col("m.lo"))
    hi = F.when(two & (F.col("m.hi") == F.col("caller")), F.col("m.lo")).otherwise(F.col("m.hi"))
    best = sites.join(met, ["name", "site"]).where(F.exists("near", lambda x: (x["n"] > 1) | (x["lo"] != F.col("caller")))).select("caller", "name", left.alias("m")).select("caller", "name", F.col("m.level").alias("level"), lo.alias("lo"), hi.alias("hi"))
    top = best.groupBy("caller", "name").agg(F.min(F.struct((-F.col("level")).alias("l"), "lo"))["lo"].alias("target"), F.max(F.struct("level", "hi"))["hi"].alias("z"))
    return top.where("target = z").select(F.col("caller").alias("source"), "target").distinct()


def imported_calls(calls: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, relation, confidence of calls to a name that the call's file imports from a module.

    ``imports``: source_file, module (stem), name, alias.
    """
    target = nodes.where("file_type = 'code'").select(F.regexp_replace(base_name(F.col("source_file")), r"\.[^.]*$", "").alias("module"), callable_name(F.col("label")).alias("name"), F.col("id").alias("target"))
    target = target.groupBy("module", "name").agg(F.min("target").alias("target"), F.max("target").alias("z")).where("target = z").drop("z")
    local = imports.select("source_file", "module", callable_name(F.col("name")).alias("name"), callable_name(F.coalesce("alias", "name")).alias("local"))
    hit = calls.select("caller", "source_file", callable_name(F.col("callee")).alias("local")).join(local, ["source_file", "local"]).join(target, ["module", "name"]).where("caller <> target")
    return hit.select(F.col("caller").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence")).distinct()


def member_calls(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """source, target of typed member calls: the class name must be unique, its method's last record wins.

    ``calls``: caller, receiver_type, callee; ``classes``: name, id; ``methods``: class_id, name, id, pos.
    """
    c = classes.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("class_id"), F.max("id").alias("z")).where("class_id = z").drop("z")
    m = methods.groupBy("class_id", callable_name(F.col("name")).alias("m")).agg(F.max_by("id", "pos").alias("target"))
    return calls.join(c, F.lower("receiver_type") == F.col("k")).withColumn("m", callable_name(F.col("callee"))).join(m, ["class_id", "m"]).select(F.col("caller").alias("source"), "target").distinct()


def symbol_targets(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref columns and target: the symbol in the same document, else the one of that name anywhere, else a stub for an external.

    ``refs``: source, symbol, document, relation; ``symbols``: symbol, document, id.
    """
    here = symbols.groupBy("symbol", "document").agg(F.min("id").alias("near"))
    once = symbols.groupBy("symbol").agg(F.min("id").alias("far"), F.max("id").alias("z")).where("far = z").drop("z")
    j = refs.join(here, ["symbol", "document"], "left").join(once, "symbol", "left")
    return j.select("source", F.coalesce("near", "far", F.concat(F.lit("external:"), "symbol")).alias("target"), "relation", "document")


def type_references(edges: DataFrame, types: DataFrame, relations: tuple[str, ...] = ("implements", "inherits", "references")) -> DataFrame:
    """Edges to placeholder types (``type:name``) pointed at the type of that name: in the edge's name space first, else unique.

    ``types``: namespace, name, id, source_file; the first of a name in a name space by file and id.
    """
    own = types.groupBy("namespace", "name").agg(F.min(F.struct("source_file", "id")).alias("f")).select("namespace", "name", F.col("f.id").alias("_near"))
    once = types.groupBy("name").agg(F.min("id").alias("_far"), F.max("id").alias("z")).where("_far = z").drop("z")
    e = edges.withColumn("name", F.when(F.col("relation").isin(*relations) & F.col("target").startswith("type:"), F.substring("target", 6, 1 << 20)))
    out = e.join(own, ["namespace", "name"], "left").join(once, "name", "left")
    return out.withColumn("target", F.coalesce("_near", "_far", "target")).select(*edges.columns)


def sourced_scripts(calls: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, relation of ``source x.sh`` lines: the path joined to the calling file's folder, parents resolved, must exist.

    ``calls``: source_file, argument; ``files``: path.
    """
    folder = F.regexp_replace("source_file", r"/?[^/]*$", "")
    raw = F.regexp_replace(F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("argument", r"^[\"']|[\"']$", "")), r"(^|/)\./", "$1")
    # each step folds one a/.. ; a path has at most as many as segments, and eight are ample
    for _ in range(8):
        raw = F.regexp_replace(raw, r"(^|/)(?!\.\./)[^/]+/\.\.(/|$)", "$1")
    return calls.withColumn("path", raw).join(files.select("path").distinct(), "path", "left_semi").select(F.col("source_file").alias("source"), F.col("path").alias("target"), F.lit("imports").alias("relation")).where("source <> target").distinct()


def resolve_chain(edges: DataFrame, *resolvers) -> DataFrame:
    """Resolvers applied in turn; each takes and returns the edges."""
    for r in resolvers:
        edges = r(edges)
    return edges
