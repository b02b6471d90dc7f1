"""Answers and views over a graph: path answers, substring candidates, community listings, articles, prompt lines, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name
from tessella.plans.materialize import width, written

from .prepare import running_top
from .rank import score_nodes, searchable, tokens_of
from .topology import distinct_degree, envelope_text
from .traverse import shortest_path

# --- paths


def best_match(nodes: DataFrame, query: str, gap: float = 0.10) -> tuple[str | None, bool]:
    """The best scored node of a query, and whether the second comes within ``gap`` of its score."""
    order = (F.desc("score"), F.length(F.coalesce("label", "id")), F.col("id"))
    top = score_nodes(nodes, query.lower().split()).orderBy(*order).limit(2).collect()
    if not top:
        return None, False
    return top[0].id, len(top) == 2 and top[0].score > 0 and (top[0].score - top[1].score) / top[0].score < gap


def path_answer(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """pos, line: warnings of ambiguous ends, then a line a hop with its relations; or the one line that says why there is no path."""
    spark = nodes.sparkSession
    say = lambda *lines: spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    ends, warned = [], []
    for name, query in (("source", source), ("target", target)):
        found, close = best_match(nodes, query)
        if found is None:
            return say(f"No node matches the {name} {query!r}.")
        ends.append(found)
        warned += [f"Warning: the {name} {query!r} is ambiguous."] if close else []
    if ends[0] == ends[1]:
        return say(f"Both ends mean the node {ends[0]}; give a more specific label or an id.")
    steps = [r.id for r in shortest_path(edges, *ends, most=max_hops).orderBy("hop").collect()]  # at most max_hops + 1 rows
    if not steps:
        return say(*warned, f"No path of at most {max_hops} hops.")
    hops = spark.createDataFrame([(i, min(a, b), max(a, b), a, b) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))], "i int, a string, b string, u string, v string")
    label = nodes.select("id", F.coalesce("label", "id").alias("name"))
    text = envelope_text(edges.join(hops.select(F.explode(F.array("u", "v")).alias("source")).distinct(), "source", "left_semi"))
    j = hops.join(text, ["a", "b"]).join(label.select(F.col("id").alias("u"), F.col("name").alias("from")), "u").join(label.select(F.col("id").alias("v"), F.col("name").alias("to")), "v")
    lines = j.select((F.col("i") + len(warned)).alias("pos"), F.concat("from", F.lit(" --"), "text", F.lit("-- "), "to").alias("line"))
    return say(*warned).unionByName(lines) if warned else lines


# --- substring candidates


def trigrams(nodes: DataFrame) -> DataFrame:
    """gram, id (twice only for an id of several nodes): an inverted index of the three-letter pieces of labels, bare names and source files; bucket it by gram when written."""
    texts = F.filter(F.array("norm", "bare", "src", F.lower("id")), lambda t: F.length(t) >= 3)
    grams = F.flatten(F.transform(texts, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))))
    return searchable(nodes).select(F.explode(F.array_distinct(grams)).alias("gram"), "id")


def candidates(nodes: DataFrame, index: DataFrame, needles: list[str], share: float = 0.10) -> DataFrame | None:
    """id of the nodes that may contain a needle: those that have all of its trigrams. A superset, so scoring them gives what a scan gives.

    None, for a scan, if a needle is too short or even its rarest trigram is in over ``share`` of the nodes.
    """
    wanted = [n for n in needles if n]
    if any(len(n) < 3 for n in wanted):
        return None
    pairs = [(k, n[i : i + 3]) for k, n in enumerate(wanted) for i in range(len(n) - 2)]
    if not pairs:
        return nodes.select("id").where("false")
    asked = nodes.sparkSession.createDataFrame(sorted(set(pairs)), "k int, gram string")
    hit = index.join(F.broadcast(asked), "gram")  # the needles' few trigrams
    # a row an id, gathered after a shuffle: the few tasks that read the nodes hold nothing
    own = written(hit.repartition(width(nodes.sparkSession), "id").groupBy("id").agg(F.collect_set(F.struct("k", "gram")).alias("g")), "grams")
    often = {(r.k, r.gram): r.n for r in own.select(F.inline("g")).groupBy("k", "gram").agg(F.count("*").alias("n")).collect()}
    most = int(nodes.count() * share)
    sizes: dict[int, set[str]] = {}
    for k, g in pairs:
        sizes.setdefault(k, set()).add(g)
    for k, grams in sizes.items():
        present = [often[k, g] for g in grams if (k, g) in often]
        if present and min(present) > most:
            return None

    def whole(k: int) -> Column:
        return F.size(F.filter("g", lambda x: x["k"] == k)) == len(sizes[k])

    return own.where(reduce(Column.__or__, map(whole, sizes))).select("id")


def score_by_index(nodes: DataFrame, index: DataFrame, terms: list[str]) -> DataFrame:
    """As ``score_nodes``, reading only candidates where the index is selective; rarities still come from all nodes."""
    found = candidates(nodes, index, [t for term in terms for t in tokens_of(term)])
    if found is None:
        return score_nodes(nodes, terms)
    return score_nodes(nodes, terms, nodes.join(found, "id", "left_semi"))


# --- views


def preferred_file(nodes: DataFrame, matches: DataFrame, query: str) -> str | None:
    """Of matched nodes the one that is the file itself: its label is the base name of the source, or of the query; None unless it is one."""
    name = query.replace("\\", "/").rsplit("/", 1)[-1]
    own = nodes.join(matches.select("id"), "id", "left_semi").where((F.col("label") == base_name(F.col("source_file"))) | (F.col("label") == name))
    ids = [r.id for r in own.select("id").distinct().limit(2).collect()]
    return ids[0] if len(ids) == 1 else None


def community_members(nodes: DataFrame, edges: DataFrame, community: int | None = None) -> DataFrame:
    """community, id, label, degree of one community, or of all."""
    n = nodes.where("community is not null") if community is None else nodes.where(F.col("community") == community)
    return n.join(distinct_degree(nodes, edges), "id").select("community", "id", F.coalesce("label", "id").alias("label"), "degree")


def display_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, name: its hub's label, with the number behind it where several communities have that label."""
    from .community import hub_labels

    size = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"))
    j = size.join(hub_labels(nodes, edges), "community")
    same = j.groupBy("label").agg(F.count("*").alias("n"))
    return j.join(same, "label").select("community", "size", F.when(F.col("n") > 1, F.concat("label", F.lit(" ("), F.col("community").cast("string"), F.lit(")"))).otherwise(F.col("label")).alias("name"))


def home_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """node, name: the community name of every id and every label; a label of several communities has the smallest's."""
    n = nodes.where("community is not null")
    keys = n.select(F.col("id").alias("node"), "community").union(n.where("label is not null").select("label", "community"))
    least = keys.groupBy("node").agg(F.min("community").alias("community"))
    return least.join(names, "community").select("node", "name")


def members_of(groups: DataFrame) -> DataFrame:
    """id, community from community, nodes (array): the groups turned round; an id of several keeps the smallest."""
    return groups.select(F.explode("nodes").alias("id"), "community").groupBy("id").agg(F.min("community").alias("community"))


def first_labels(nodes: DataFrame, top: int = 4) -> DataFrame:
    """community, labels: the labels of its first nodes by id."""
    rows = running_top(nodes.where("community is not null").select("community", "id", F.coalesce("label", "id").alias("label")), ["community"], [F.col("id")], top)
    return rows.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))


def prompt_lines(nodes: DataFrame, edges: DataFrame, gods: DataFrame, most: int = 100, top: int = 12) -> DataFrame:
    """community, line: the distinct labels of the largest communities, god nodes first, then by degree, for a naming prompt."""
    size = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(most)
    n = community_members(nodes, edges).join(size.select("community"), "community", "left_semi").join(gods.select("id", F.lit(0).alias("god")), "id", "left")
    each = n.groupBy("community", "label").agg(F.min(F.struct(F.coalesce("god", F.lit(1)).alias("g"), (-F.col("degree")).alias("d"), "id")).alias("o"))
    rows = running_top(each, ["community"], [F.col("o")], top)
    labels = F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])
    return rows.groupBy("community").agg(labels.alias("l")).select("community", F.concat(F.col("community").cast("string"), F.lit(": "), F.array_join("l", ", ")).alias("line"))


def god_articles(nodes: DataFrame, edges: DataFrame, gods: DataFrame, most: int = 20) -> DataFrame:
    """id, direction, rank, other, relation: of each god node its first neighbours in and out, by their degree."""
    d = distinct_degree(nodes, edges).select(F.col("id").alias("other"), "degree")
    g = F.broadcast(gods.select("id"))  # a top-k report
    out = edges.join(g, edges.source == g.id).select("id", F.lit("out").alias("direction"), F.col("target").alias("other"), "relation")
    into = edges.join(g, edges.target == g.id).select("id", F.lit("in").alias("direction"), F.col("source").alias("other"), "relation")
    each = out.unionByName(into).groupBy("id", "direction", "other").agg(F.min("relation").alias("relation")).join(d, "other")
    return running_top(each, ["id", "direction"], [F.desc("degree"), F.col("other")], most).select("id", "direction", "rank", "other", "relation")


def learning_lines(verdicts: DataFrame, top: int = 10) -> DataFrame:
    """verdict, rank, node, score: the first nodes of each verdict, for a report."""
    kind = F.when(F.col("verdict").startswith("contested"), "contested").otherwise(F.col("verdict"))
    return running_top(verdicts.withColumn("verdict", kind), ["verdict"], [F.desc("score"), F.col("node")], top).select("verdict", "rank", "node", "score")


def by_file(nodes: DataFrame) -> DataFrame:
    """source_file, n: nodes by file, the fullest first."""
    return nodes.groupBy(F.coalesce("source_file", F.lit("")).alias("source_file")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file")


def request_list(requests: DataFrame, most: int = 50) -> DataFrame:
    """number, title, status of open requests, the latest first."""
    return requests.orderBy(F.desc("updated_at"), F.desc("number")).select("number", "title", "status").limit(most)


def suppressions(lines: DataFrame) -> DataFrame:
    """path, line, kind of the comments that switch a checker off. ``lines``: path, line, text."""
    kind = F.regexp_extract("text", r"(?i)(?:#|//|/\*)\s*(noqa|nosec|type:\s*ignore|pylint:\s*disable|eslint-disable\S*|nolint|@ts-ignore|pragma:\s*no\s*cover)", 1)
    return lines.select("path", "line", F.lower(F.regexp_replace(kind, r"\s+", " ")).alias("kind")).where("kind <> ''")


def node_kind(label: Column, source_file: Column, file_type: Column) -> Column:
    """What a chart draws: method, function, file, class, concept or document."""
    x = F.coalesce(label, F.lit(""))
    return (
        F.when(x.startswith(".") & x.endswith("()"), "method").when(x.endswith("()"), "function").when((x != "") & (x == base_name(source_file)), "file")
        .when((file_type == "code") & x.rlike(r"^[A-Z]\w*$"), "class").when(file_type == "code", "symbol").otherwise(F.coalesce(file_type, F.lit("concept")))
    )


def human_label(label: Column) -> Column:
    """A name in words: camel case and underscores apart, call brackets and leading dots gone."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"\(\)$", ""), r"^\.+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " "), r"\s+", " "))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Money for tokens at prices a million."""
    return (input_tokens * input_price + output_tokens * output_price) / 1e6


def changed_during(before: DataFrame, after: DataFrame) -> DataFrame:
    """path of the snapshot's files whose hash is another now, or which are gone. Both: path, hash."""
    j = before.select("path", F.col("hash").alias("_a")).join(after.select("path", F.col("hash").alias("_b")), "path", "left")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path")
