"""Sinks: graph JSON, Cypher, GraphML, Markdown reports and vaults, tree JSON, append-only logs. Rows are made by columns; only
outputs that are one document by nature (and bounded by a check) come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import safe_stem
from tessella.functions.text import confidence_score, cypher_text, yaml_text
from tessella.operators.topology import distinct_degree, dominant_confidence

VIEW_NODES = 5_000


def published(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with norm_label, edges with a confidence and its score (a missing confidence is EXTRACTED here)."""
    n = nodes.withColumn("norm_label", F.lower(F.coalesce("label", "id")))
    c = F.coalesce("confidence", F.lit("EXTRACTED"))
    return n, edges.withColumn("confidence_score", confidence_score(F.col("confidence_score"), c, 1.0)).withColumn("confidence", c)


def write_store(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The canonical form: two Parquet tables, each replaced by the committer as a whole."""
    n, e = published(nodes, edges)
    n.write.mode("overwrite").parquet(f"{path}/nodes")
    e.write.mode("overwrite").parquet(f"{path}/edges")


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a record: a node-link document in lines, for any size."""
    n, e = published(nodes, edges)
    return n.select(F.to_json(F.struct(F.lit("node").alias("record"), *n.columns)).alias("value")).union(e.select(F.to_json(F.struct(F.lit("link").alias("record"), *e.columns)).alias("value")))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One MERGE statement a row; names of relations are reduced to letters, digits and underscores."""
    kind = F.regexp_replace(F.initcap(F.coalesce("file_type", F.lit("concept"))), r"[^A-Za-z0-9_]", "_")
    n = nodes.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), cypher_text(F.col("id")), F.lit("'}) SET n.label = '"), cypher_text(F.coalesce("label", "id")), F.lit("';")).alias("value"))
    rel = F.upper(F.regexp_replace(F.coalesce("relation", F.lit("related_to")), r"[^A-Za-z0-9_]", "_"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: '"), cypher_text(F.col("source")), F.lit("'}), (b {id: '"), cypher_text(F.col("target")), F.lit("'}) MERGE (a)-[r:"), rel, F.lit(" {key: '"), cypher_text(F.coalesce("key", F.lit(""))), F.lit("'}]->(b) SET r.confidence = '"), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("';")).alias("value"))
    return n.union(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (part, value) of a GraphML document, to be written in order of part."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    head = nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="label">'), esc(F.col("label")), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc(F.col("source")), F.lit('" target="'), esc(F.col("target")), F.lit('"><data key="relation">'), esc(F.col("relation")), F.lit("</data></edge>")).alias("value"))
    return head.union(n).union(e)


def vault(nodes: DataFrame, edges: DataFrame, links: int = 50) -> DataFrame:
    """file, text: one Markdown note a node with tags, dominant confidence and its first links by name; the rest are counted."""
    from tessella.operators.prepare import running_top
    from tessella.operators.topology import both_ways

    near = both_ways(edges, "relation").where("a <> b").distinct()
    top = running_top(near, ["a"], [F.col("b"), F.col("relation")], links).groupBy("a").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "relation", F.lit(" [["), "b", F.lit("]]")))), "\n").alias("links"))
    n = nodes.join(distinct_degree(nodes, edges), "id").join(dominant_confidence(nodes, edges), "id").join(top, nodes.id == top.a, "left")
    text = F.concat(F.lit("---\nid: "), yaml_text(F.col("id")), F.lit("\ntags: ["), F.coalesce("file_type", F.lit("concept")), F.lit(", "), F.lower("confidence"), F.lit("]\n---\n# "), F.coalesce("label", "id"), F.lit("\n\nLinked to "), F.col("degree").cast("string"), F.lit(" others.\n"), F.coalesce("links", F.lit("")), F.lit("\n"))
    return n.select(F.concat(safe_stem(F.col("id")), F.lit(".md")).alias("file"), text.alias("text"))


def viewer_html(nodes: DataFrame, edges: DataFrame, title: str = "graph") -> str:
    """A page with the graph inside; refused above ``VIEW_NODES`` nodes."""
    n = nodes.select("id", "label", "community").limit(VIEW_NODES + 1).collect()
    if len(n) > VIEW_NODES:
        raise ValueError(f"a viewer holds at most {VIEW_NODES} nodes; aggregate by community first")
    e = edges.select("source", "target", "relation").limit(20 * VIEW_NODES + 1).collect()
    if len(e) > 20 * VIEW_NODES:
        raise ValueError("too many edges for a viewer")
    data = json.dumps({"nodes": [r.asDict() for r in n], "links": [r.asDict() for r in e]}).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><pre id="out"></pre><script>const graph = {data};document.getElementById("out").textContent = graph.nodes.length + " nodes, " + graph.links.length + " links";</script>'


def report(nodes: DataFrame, edges: DataFrame, top: int = 10) -> str:
    """A Markdown report from small aggregates: size, confidence mix, most connected, surprises, communities, gaps."""
    from tessella.operators.community import cohesion, hub_labels
    from tessella.operators.rank import surprises
    from tessella.operators.topology import god_nodes, graph_stats

    s = graph_stats(nodes, edges).first()
    lines = ["# Graph report", "", f"{s.nodes} nodes, {s.edges} edges, {s.communities} communities. Extracted {s.extracted} %, inferred {s.inferred} %, ambiguous {s.ambiguous} %.", "", "## Most connected"]
    lines += [f"- {r.label}: {r.degree}" for r in god_nodes(nodes, edges, top).collect()]
    lines += ["", "## Surprising links"] + [f"- {r.source} -> {r.target} ({r.relation}, {r.confidence.lower()}, {r.score})" for r in surprises(nodes, edges, 5).collect()]
    c = cohesion(nodes, edges).join(hub_labels(nodes, edges), "community", "left").orderBy(F.desc("size"), "community").limit(25).collect()
    lines += ["", "## Communities"] + [f"- {r.community} {r.label}: {r.size} nodes, cohesion {r.cohesion:.3f}" for r in c]
    d = nodes.join(distinct_degree(nodes, edges), "id")
    gaps = d.where("degree <= 1 and coalesce(file_type, '') <> 'rationale'").count()
    return "\n".join([*lines, "", "## Gaps", f"- {gaps} nodes have at most one neighbour", *(["- over 20 % of the edges are ambiguous"] if s.ambiguous > 20 else [])]) + "\n"


def tree_json(rollup: DataFrame, most: int = 200) -> str:
    """Nested JSON of a folder rollup (prefix, depth, files, items), each folder's largest ``most`` children and a count of the rest."""
    from tessella.operators.prepare import running_top

    parent = F.regexp_replace("prefix", r"/?[^/]*$", "")
    rows = running_top(rollup.withColumn("parent", parent), ["parent"], [F.desc("items"), F.col("prefix")], most).limit(50_001).collect()
    if len(rows) > 50_000:
        raise ValueError("the tree is too large for one document; roll up to fewer levels")
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r)

    def node(r) -> dict:
        return {"name": r.prefix.rsplit("/", 1)[-1], "items": r["items"], "children": [node(c) for c in below.get(r.prefix, [])]}

    return json.dumps({"name": "", "children": [node(r) for r in below.get("", [])]})


def mermaid(links: DataFrame, most: int = 60) -> str:
    """A flow chart of the heaviest section links. ``links``: a, b, count, relation."""
    rows = links.orderBy(F.desc("count"), "a", "b").limit(most).collect()
    return "\n".join(["flowchart LR", *(f'  {r.a}["{r.a}"] -->|"{r.relation} x{r["count"]}"| {r.b}["{r.b}"]' for r in rows)])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def wiki(nodes: DataFrame, edges: DataFrame, top: int = 25) -> DataFrame:
    """file, text: an article a community with its most connected members, confidence mix of incident edges and links to others."""
    from tessella.operators.community import cohesion, cross_counts, hub_labels
    from tessella.operators.prepare import running_top

    d = nodes.join(distinct_degree(nodes, edges), "id").where("community is not null")
    members = running_top(d, ["community"], [F.desc("degree"), F.col("id")], top).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.coalesce("label", "id"), F.lit(" ("), F.col("degree").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]), "\n").alias("members"))
    near = running_top(cross_counts(nodes, edges), ["community"], [F.desc("links"), F.col("other")], 10).groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- [[community-"), F.col("other").cast("string"), F.lit("]] x"), F.col("links").cast("string")).alias("t")))), lambda x: x["t"]), "\n").alias("near"))
    c = cohesion(nodes, edges).join(hub_labels(nodes, edges), "community").join(members, "community").join(near, "community", "left")
    text = F.concat(F.lit("# "), F.coalesce("label", F.lit("community")), F.lit("\n\n"), F.col("size").cast("string"), F.lit(" nodes, cohesion "), F.format_number("cohesion", 3), F.lit("\n\n## Members\n"), "members", F.lit("\n\n## Linked\n"), F.coalesce("near", F.lit("")), F.lit("\n"))
    return c.select(F.concat(F.lit("community-"), F.col("community").cast("string"), F.lit(".md")).alias("file"), text.alias("text"))


def layout(nodes: DataFrame, edges: DataFrame) -> list[tuple[str, str, float, float]]:
    """(id, label, x, y) on a circle in order of community and id, for at most ``VIEW_NODES`` nodes."""
    import math

    rows = nodes.select("id", "label", "community").orderBy("community", "id").limit(VIEW_NODES + 1).collect()
    if len(rows) > VIEW_NODES:
        raise ValueError(f"a drawing holds at most {VIEW_NODES} nodes; aggregate by community first")
    n = max(len(rows), 1)
    return [(r.id, r.label or r.id, 500 + 450 * math.cos(2 * math.pi * i / n), 500 + 450 * math.sin(2 * math.pi * i / n)) for i, r in enumerate(rows)]


def drawn(edges: DataFrame, ids) -> list:
    """The distinct links between the drawn nodes, in order; refused above twenty a node."""
    inner = edges.where(F.col("source").isin(*ids) & F.col("target").isin(*ids)) if len(ids) <= 500 else edges
    rows = inner.select("source", "target").distinct().orderBy("source", "target").limit(20 * VIEW_NODES + 1).collect()
    if len(rows) > 20 * VIEW_NODES:
        raise ValueError("too many edges for a drawing")
    return [r for r in rows if r.source in ids and r.target in ids]


def svg(nodes: DataFrame, edges: DataFrame) -> str:
    from html import escape

    at = {i: (x, y, t) for i, t, x, y in layout(nodes, edges)}
    lines = [f'<line x1="{at[r.source][0]:.1f}" y1="{at[r.source][1]:.1f}" x2="{at[r.target][0]:.1f}" y2="{at[r.target][1]:.1f}" stroke="#999"/>' for r in drawn(edges, at)]
    dots = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"><title>{escape(t)}</title></circle>' for x, y, t in at.values()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">{"".join(lines + dots)}</svg>'


def canvas(nodes: DataFrame, edges: DataFrame) -> str:
    """A canvas document: a card a node, placed on a circle, and the links between them."""
    cards = [{"id": i, "type": "text", "text": t, "x": round(x), "y": round(y), "width": 200, "height": 60} for i, t, x, y in layout(nodes, edges)]
    links = [{"id": f"e{k}", "fromNode": r.source, "toNode": r.target} for k, r in enumerate(drawn(edges, {c["id"] for c in cards}))]
    return json.dumps({"nodes": cards, "edges": links})


def write_egress(decisions: DataFrame, path: str) -> None:
    """The decisions without content, each once, in order."""
    decisions.select("path", "eligible", "reason", "digest").dropDuplicates().orderBy("path", "digest").write.mode("overwrite").json(path)


def saved_answer(spark, question: str, text: str, source_nodes: list[str], outcome: str | None = None, date: str | None = None) -> DataFrame:
    """One row of a feedback document with at most ten source nodes, for an append."""
    from tessella.functions.text import slug

    head = [f"date: {date}" if date else "", f"question: {json.dumps(question)}", f"outcome: {outcome}" if outcome else "", f"source_nodes: {json.dumps(source_nodes[:10])}"]
    body_ = "---\n" + "\n".join(h for h in head if h) + "\n---\n" + text
    return spark.createDataFrame([(slug(question)[:80] + ".md", body_)], "file string, text string")


def push_graph(nodes: DataFrame, edges: DataFrame, connect) -> None:
    """Sends the Cypher lines to a server, a partition a session. ``connect`` gives a context manager with ``run`` (no client is bundled)."""
    def send(rows) -> None:
        with connect() as session:
            for r in rows:
                session.run(r.value)

    lines = cypher(nodes, edges)
    lines.where("value like 'MERGE%'").foreachPartition(send)
    lines.where("value like 'MATCH%'").foreachPartition(send)
