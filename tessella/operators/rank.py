"""Question answering over a graph: terms, document frequencies, node scores, seeds, lookup ladders, budgeted rendering, surprises."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.paths import category, cross_language, top_dir
from tessella.functions.text import bare_name, plain
from tessella.plans.materialize import written

from .topology import both_ways, context_edges, distinct_degree, envelope_text, is_concept, is_file_node
from .traverse import expand

STOP = frozenset("a about and are does do for from how in is it of on the this to what when where which who why with".split())
CONTEXTS = {
    "call": "call called calls invocation invoke invoked invokes",
    "field": "field fields member members properties property",
    "generic_arg": "generic generics template templates",
    "import": "import imported imports module modules",
    "parameter_type": "arg args argument arguments param parameter parameters params",
    "return_type": "return returned returns",
    "export": "export exported exports",
    "attribute": "annotation annotations attribute decorator decorators",
}
EXACT, PREFIX, PART, SOURCE = 1000.0, 100.0, 1.0, 0.5


def tokens_of(text: str) -> list[str]:
    return re.findall(r"\w+", plain(text).lower())


def query_terms(question: str) -> list[str]:
    """Search words of a question in order: no stop words, more than two letters; runs of Han characters as bigrams."""
    out: list[str] = []
    for t in tokens_of(question):
        han = re.findall(r"[一-鿿]+", t)
        if han:
            out += [h[i : i + 2] for h in han for i in range(max(1, len(h) - 1))]
        elif len(t) > 2 and t not in STOP:
            out.append(t)
    return list(dict.fromkeys(out))


def context_filters(values: list[str] | None) -> list[str]:
    """Names of contexts, aliases resolved, each once."""
    alias = {w: c for c, ws in CONTEXTS.items() for w in ws.split()}
    keys = (plain(v).strip().lower() for v in values or [])
    return list(dict.fromkeys(alias.get(k, k) for k in keys if k))


def infer_contexts(question: str) -> list[str]:
    said = {plain(w).lower() for w in re.sub(r"[?,]", " ", question).split()}
    return [c for c in ("call", "import", "field", "parameter_type", "return_type", "generic_arg") if said & (set(CONTEXTS[c].split()) - {"arg", "args", "invocation"})]


def searchable(nodes: DataFrame) -> DataFrame:
    """Adds norm (lower label), bare (without call brackets), toks (words joined by spaces), src; accents are dropped for Latin letters in the JVM."""
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    norm = F.translate(F.lower(F.coalesce("label", F.lit(""))), *accents)
    return nodes.withColumn("norm", norm).withColumn("bare", F.regexp_replace("norm", r"[()]+$", "")).withColumn("toks", F.array_join(F.regexp_extract_all("norm", F.lit(r"(?U)\w+"), 0), " ")).withColumn("src", F.lower(F.coalesce("source_file", F.lit(""))))


def idf(nodes: DataFrame, terms: list[str]) -> dict[str, float]:
    """ln(1 + n / (1 + df)) by term, df counting labels that contain it: one aggregate over the nodes, a column a term."""
    import math

    terms = list(dict.fromkeys(terms))
    row = searchable(nodes).agg(F.count("*").alias("n"), *(F.count(F.when(F.col("norm").contains(t), 1)).alias(f"t{i}") for i, t in enumerate(terms))).first()
    n = max(row["n"], 1)
    return {t: math.log(1 + n / (1 + row[f"t{i}"])) for i, t in enumerate(terms)}


def score_nodes(nodes: DataFrame, terms: list[str], among: DataFrame | None = None) -> DataFrame:
    """id, label, score above 0 of the nodes (or of those ``among`` them). Per term the strongest of exact, prefix and part, plus a source match, by rarity; the whole query
    as a label counts ten times the rarest term."""
    toks = [t for term in terms for t in tokens_of(term)]
    if not toks:
        return nodes.select("id", "label", F.lit(0.0).alias("score")).where("false")
    weight = idf(nodes, toks)
    joined, top = " ".join(toks), max(weight.values())
    norm, bare, words, src = (F.col(c) for c in ("norm", "bare", "toks", "src"))
    whole = (norm == joined) | (bare == joined) | (words == joined) | (F.lower("id") == joined)
    starts = norm.startswith(joined) | bare.startswith(joined) | words.startswith(joined)
    score = F.when(whole, EXACT * 10 * top).when(starts, PREFIX * 10 * top).otherwise(0.0)
    for t in toks:
        w = weight[t]
        score = score + F.when((norm == t) | (bare == t), EXACT * w).when(norm.startswith(t) | bare.startswith(t), PREFIX * w).when(norm.contains(t), PART * w).otherwise(0.0)
        score = score + F.when(src.contains(t), SOURCE * w).otherwise(0.0)
    return searchable(nodes if among is None else among).select("id", "label", score.alias("score")).where("score > 0")


def seeds(scored: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """The first rows by (score, shorter label, id) while they have at least ``gap`` of the best score."""
    first = scored.orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id").limit(most)
    return first.withColumn("best", F.max("score").over(Window.partitionBy())).where(F.col("score") >= gap * F.col("best")).select("id", "label", "score")  # at most ``most`` rows


def find_node(nodes: DataFrame, query: str) -> DataFrame:
    """id, tier of every node that a query names: 0 raw id or label, 1 source, 2 normalised, 3 prefix, 4 part; best tier first."""
    q = plain(query).strip().lower()
    s = searchable(nodes)
    tier = F.when((F.col("id") == query) | (F.col("label") == query), 0).when(F.col("src") == q, 1).when((F.col("norm") == q) | (F.col("bare") == q) | (F.col("toks") == " ".join(tokens_of(q))), 2).when(F.col("norm").startswith(q), 3).when(F.col("norm").contains(q), 4)
    return s.select("id", "label", tier.alias("tier")).where("tier is not null").orderBy("tier", "id")


def resolve_seed(nodes: DataFrame, query: str) -> str | None:
    """The one node a query means: exact id, else the first of label, bare name, source file, part of label that is unique."""
    n = nodes.select("id", F.lower(F.coalesce("label", F.lit(""))).alias("l"), bare_name(F.coalesce("label", F.lit(""))).alias("b"), F.lower(F.coalesce("source_file", F.lit(""))).alias("s"))
    q = query.strip().lower()
    bare = re.sub(r"\(\)$", "", q)
    tiers = [F.col("id") == query, F.col("l") == q, F.col("b") == bare, F.col("s") == q, F.col("l").contains(q)]
    row = n.agg(*(F.count(F.when(t, 1)).alias(f"n{i}") for i, t in enumerate(tiers)), *(F.min(F.when(t, F.col("id"))).alias(f"m{i}") for i, t in enumerate(tiers))).first()
    return next((row[f"m{i}"] for i in range(len(tiers)) if row[f"n{i}"] == 1), None)


def render(nodes: DataFrame, edges: DataFrame, visited: DataFrame, budget: int = 2000, pairs: DataFrame | None = None) -> DataFrame:
    """Lines of a subgraph by (degree, id), then its edges, cut where three characters a token are used up: pos, line."""
    d = distinct_degree(nodes, edges, pairs)
    n = visited.select("id").join(nodes, "id").join(d, "id")
    node_line = F.concat(F.lit("NODE "), F.coalesce("label", "id"), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit("]"))
    a = n.select(F.lit(0).alias("part"), (-F.col("degree")).alias("rank"), F.col("id").alias("tie"), node_line.alias("line"))
    ids = visited.select("id").distinct()
    inner = envelope_text(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    b = inner.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("rank"), F.concat_ws("\u001f", "a", "b").alias("tie"), F.concat(F.lit("EDGE "), "a", F.lit(" --"), "text", F.lit("-- "), "b").alias("line"))
    order = Window.orderBy("part", "rank", "tie")
    # a line has 13 characters at least, so no more than this many can be shown: the window sees a bounded, already ordered head
    head = a.unionByName(b).orderBy("part", "rank", "tie").limit(budget // 4 + 1)
    lines = head.withColumn("pos", F.row_number().over(order)).withColumn("used", F.sum(F.length("line") + 1).over(order))
    return lines.where(F.col("used") <= 3 * budget).select("pos", "line")


def answer(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 3, budget: int = 2000, contexts: list[str] | None = None) -> DataFrame:
    """A question end to end: terms, scores over the whole graph, seeds, context filter, expansion, rendering."""
    start = seeds(score_nodes(nodes, query_terms(question)))
    e = context_edges(edges, context_filters(contexts) or infer_contexts(question))
    pairs = written(both_ways(e).distinct(), "near")
    visited, _ = expand(nodes, e, start, depth, pairs=pairs)
    return render(nodes, e, visited, budget, pairs)


def surprises(nodes: DataFrame, edges: DataFrame, top: int | None = 5) -> DataFrame:
    """Cross-file edges between real entities by a score of confidence, kind, folder, community and reach."""
    d = distinct_degree(nodes, edges)
    n = nodes.join(d, "id").select("id", "label", "source_file", "community", "degree")
    skip = is_concept(F.col("source_file")) | is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))
    real = n.where(~skip & (F.coalesce("source_file", F.lit("")) != ""))
    u, v = (real.select(*(F.col(c).alias(f"{p}_{c}") for c in real.columns)) for p in ("u", "v"))
    e = edges.where(~F.coalesce("relation", F.lit("")).isin("imports", "imports_from", "contains", "method"))
    j = e.join(u, e.source == F.col("u_id")).join(v, F.col("target") == F.col("v_id")).where("u_source_file <> v_source_file")
    a, b = F.col("u_source_file"), F.col("v_source_file")
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    mixed = F.array_sort(F.array(category(a), category(b))) == F.array(F.lit("code"), F.lit("doc"))
    quiet = (conf == "INFERRED") & F.col("relation").isin("calls", "uses") & (cross_language(a, b) | mixed)

    def bonus(cond: Column, n: int) -> Column:
        return F.when(~quiet & cond, n).otherwise(0)

    base = F.when(quiet, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    inner = base + bonus(category(a) != category(b), 2) + bonus(top_dir(a) != top_dir(b), 2) + bonus(F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False)), 1)
    inner = F.when(F.col("relation") == "semantically_similar_to", F.floor(inner * 1.5)).otherwise(inner).cast("int")
    reach = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    out = j.select("source", "target", "relation", conf.alias("confidence"), "key", (inner + F.when(reach, 1).otherwise(0)).alias("score"))
    return out.orderBy(F.desc("score"), "source", "target", "relation", "confidence", "key").limit(top) if top else out


def cross_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge per pair of communities: the least certain, then by ids."""
    c = nodes.select("id", "community").where("community is not null")
    j = edges.join(c.select(F.col("id").alias("source"), F.col("community").alias("cu")), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("cv")), "target").where("cu <> cv")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), "source", "target", "relation", "key", "confidence"))
    out = j.groupBy(F.least("cu", "cv").alias("ca"), F.greatest("cu", "cv").alias("cb")).agg(best.alias("r"))
    return out.select("ca", "cb", "r.source", "r.target", "r.relation", "r.confidence")


def questions(nodes: DataFrame, edges: DataFrame, top: int = 7, most: int = 50_000) -> DataFrame:
    """Suggested questions: ambiguous edges, then the three nodes most paths pass, then hubs with inferred edges, then isolated
    nodes, then loose communities. Above 1,000 nodes paths are counted from 100 of them, above ``most`` nodes not at all.
    """
    from .community import betweenness, cohesion

    d = nodes.join(distinct_degree(nodes, edges), "id")
    amb = edges.where("confidence = 'AMBIGUOUS'").select(F.lit(1).alias("part"), F.lit(0.0).alias("rank"), F.concat_ws("\u001f", "source", "target", "key").alias("tie"), F.concat(F.lit("Is "), "source", F.lit(" really related to "), "target", F.lit("?")).alias("question"))
    real = d.where(~is_concept(F.col("source_file")) & ~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")))
    inf = edges.where("confidence = 'INFERRED'").select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2")
    hubs = real.join(inf, "id").orderBy(F.desc("degree"), "id").limit(5).select(F.lit(3).alias("part"), (-F.col("degree")).cast("double").alias("rank"), F.col("id").alias("tie"), F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred links of "), F.coalesce("label", "id"), F.lit(" right?")).alias("question"))
    lone = real.where("degree <= 1").agg(F.count("*").alias("n"), F.min("id").alias("i")).where("n > 0").select(F.lit(4).alias("part"), F.lit(0.0).alias("rank"), F.lit("").alias("tie"), F.concat(F.lit("What connects "), "i", F.lit(" and others to the rest? ("), F.col("n").cast("string"), F.lit(" nodes)")).alias("question"))
    loose = cohesion(nodes, edges).where("size >= 5 and cohesion < 0.15").select(F.lit(5).alias("part"), "cohesion", F.lpad(F.col("community").cast("string"), 12, "0").alias("tie"), F.concat(F.lit("Should community "), F.col("community").cast("string"), F.lit(" be split?")).alias("question")).withColumnRenamed("cohesion", "rank")
    n = nodes.count()
    parts = [amb, hubs, lone, loose]
    if n <= most:
        scores, _ = betweenness(nodes, edges, most, 100 if n > 1000 else None)
        bridge = real.join(scores, "id").where("score > 0").orderBy(F.desc("score"), "id").limit(3)
        parts.append(bridge.select(F.lit(2).alias("part"), (-F.col("score")).alias("rank"), F.col("id").alias("tie"), F.concat(F.lit("Why do so many paths pass "), F.coalesce("label", "id"), F.lit("?")).alias("question")))
    return reduce(DataFrame.unionByName, parts).orderBy("part", "rank", "tie").limit(top).select("part", "question")
