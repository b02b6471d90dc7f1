"""A library of graphs from several repositories: added, replaced, removed and listed; and rules for fragments of graphs."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import combine, detach, fingerprint, hyperedges, remap_ids, with_repo

NODE = ["id", "local_id", "label", "source_file", "repo", "owners"]
EDGE = ["source", "target", "relation", "key", "repo"]


def add_repo(library: tuple[DataFrame, DataFrame] | None, entries: dict[str, dict], tag: str, nodes: DataFrame, edges: DataFrame) -> tuple[tuple[DataFrame, DataFrame], dict[str, dict], dict]:
    """The library with a repository's graph in it (replacing an earlier one of that tag), its entries, and what was done.

    Unchanged graphs are skipped by fingerprint. Nodes without a source file are shared by label: they are mapped onto the
    library's own, which gains an owner.
    """
    mark = fingerprint(nodes, ["id", "label", "source_file"]) + fingerprint(edges, ["source", "target", "relation", "key"])
    if library is not None and entries.get(tag, {}).get("fingerprint") == mark:
        return library, entries, {"repo": tag, "added": 0, "removed": 0, "skipped": True}
    removed = 0
    if library is not None and tag in entries:
        library, removed = taken_out(library, tag)
    own = with_repo(nodes.select("id", "label", "source_file"), tag, ["id"]).withColumn("owners", F.array(F.lit(tag))).select(*NODE)
    links = with_repo(edges.select("source", "target", "relation", "key"), tag, ["source", "target"]).select(*EDGE)
    shared = F.coalesce("source_file", F.lit("")) == ""
    outer = own.where(shared & (F.coalesce("label", F.lit("")) != ""))
    first = outer.groupBy("label").agg(F.min("id").alias("_new"))
    if library is not None:
        known = library[0].where(shared).groupBy("label").agg(F.min("id").alias("_known"))
        first = first.join(known, "label", "left").select("label", F.coalesce("_known", "_new").alias("_new"))
    remap = outer.join(first, "label").where("id <> _new").select(F.col("id").alias("old"), F.col("_new").alias("new"))
    kept = own.join(remap.select(F.col("old").alias("id")), "id", "left_anti").select(*NODE)
    links = remap_ids(links, remap)
    if library is not None:
        gained = remap.select(F.col("new").alias("id")).distinct().withColumn("_gain", F.lit(True))
        before = library[0].join(gained, "id", "left")
        owners = F.when(F.col("_gain"), F.array_sort(F.array_union("owners", F.array(F.lit(tag))))).otherwise(F.col("owners"))
        kept, links = combine(before.withColumn("owners", owners).select(*NODE), kept), combine(library[1], links)
    added = nodes.select("id").distinct().count() - remap.count()
    entries = entries | {tag: {"fingerprint": mark, "nodes": added, "edges": edges.count()}}
    return (kept, links), entries, {"repo": tag, "added": added, "removed": removed, "skipped": False}


def taken_out(library: tuple[DataFrame, DataFrame], tag: str) -> tuple[tuple[DataFrame, DataFrame], int]:
    """Nodes whose last owner goes, and the tag's own edges and those left without an end."""
    from .merge import live_edges

    kept = detach(library[0], tag)
    left = live_edges(kept, library[1].where(F.col("repo") != tag))
    return (kept, left), library[0].count() - kept.count()


def remove_repo(library: tuple[DataFrame, DataFrame], entries: dict[str, dict], tag: str) -> tuple[tuple[DataFrame, DataFrame], dict[str, dict], int]:
    if tag not in entries:
        raise KeyError(tag)
    library, removed = taken_out(library, tag)
    return library, {k: v for k, v in entries.items() if k != tag}, removed


def list_repos(library: tuple[DataFrame, DataFrame]) -> DataFrame:
    """repo, nodes (owned, shared ones too), edges."""
    n = library[0].select(F.explode("owners").alias("repo")).groupBy("repo").agg(F.count("*").alias("nodes"))
    e = library[1].groupBy("repo").agg(F.count("*").alias("edges"))
    return n.join(e, "repo", "left").select("repo", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


# --- fragments


def fragment_violations(nodes: DataFrame, edges: DataFrame, hyper: DataFrame, most_nodes: int = 10_000, most_edges: int = 100_000, most_members: int = 256) -> DataFrame:
    """rule, subject: a fragment beyond its bounds (each table as a whole), and hyperedges with too many members or fewer than two."""
    size = lambda df, rule, most: df.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(rule).alias("rule"), F.col("n").cast("string").alias("subject"))
    wide = hyper.where(F.size("nodes") > most_members).select(F.lit("too many members").alias("rule"), F.col("id").alias("subject"))
    thin = hyper.where(F.coalesce(F.size("nodes"), F.lit(0)) < 2).select(F.lit("fewer than two members").alias("rule"), F.col("id").alias("subject"))
    return combine(size(nodes, "too many nodes", most_nodes), size(edges, "too many edges", most_edges), wide, thin)


def merged_fragments(*parts: DataFrame) -> DataFrame:
    """Records of several model-made fragments; their origin is semantic unless it is known."""
    out = combine(*parts)
    origin = F.coalesce("origin", F.lit("semantic")) if "origin" in out.columns else F.lit("semantic")
    return out.withColumn("origin", origin)


def attached(existing: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges of a graph with new ones, by id: members live, distinct and sorted, the existing record of an id stays."""
    cols = ["id", "label", "relation", "nodes"]
    both = hyperedges(existing.select(*cols), nodes).withColumn("_n", F.lit(0)).unionByName(hyperedges(fresh.select(*cols), nodes).withColumn("_n", F.lit(1)))
    return both.groupBy("id").agg(F.min_by(F.struct(*cols[1:]), "_n").alias("r")).select("id", "r.*")


def repaired_aliases(nodes: DataFrame, hyper: DataFrame) -> DataFrame:
    """Hyperedges whose members name a file by its path or by an old id made of it point at that file's node, where just one has the path."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("source_file"), r"\.[^./]*$", ""), r"[^a-z0-9]+", "_")
    file = nodes.where((F.coalesce("source_file", F.lit("")) != "") & (F.col("label") == F.element_at(F.split("source_file", "/"), -1)))
    alias = file.select("id", F.explode(F.array_distinct(F.array(F.col("source_file"), slug))).alias("_m"))
    alias = alias.groupBy("_m").agg(F.min("id").alias("_to"), F.max("id").alias("_z")).where("_to = _z").drop("_z")
    alias = alias.join(nodes.select(F.col("id").alias("_m")), "_m", "left_anti")  # a live id is no alias
    m = hyper.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode("nodes").alias("_p", "_m")).join(alias, "_m", "left")
    rest = [c for c in hyper.columns if c != "nodes"]
    members = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_p", F.coalesce("_to", "_m").alias("x")))), lambda s: s["x"]))
    return m.groupBy("_row", *rest).agg(members.alias("nodes")).select(*hyper.columns)


def legacy_ids(nodes: DataFrame, sample: int = 300) -> bool:
    """Whether ids are of an old kind, made of the file's bare name without its folders: looked for in a sample, as one is enough."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")), r"[^a-z0-9]+", "_")
    folder = F.regexp_replace(F.lower(F.element_at(F.split("source_file", "/"), -2)), r"[^a-z0-9]+", "_")
    rows = nodes.where(F.col("source_file").contains("/")).orderBy("id").limit(sample)
    return bool(rows.where(F.col("id").startswith(stem) & ~F.col("id").contains(folder)).take(1))


# --- endpoints and JSON


def endpoint_class(endpoint: str, resolve: Callable[[str], list[str]] | None = None) -> str:
    """managed, loopback, private, public, mixed, wildcard or unresolved: where an outbound address leads. Names need ``resolve``."""
    if endpoint.startswith("managed://"):
        return "managed"
    host = urlsplit(endpoint).hostname
    if not host:
        return "unresolved"
    try:
        found = [ipaddress.ip_address(host.split("%", 1)[0])]
        if found[0].is_unspecified:
            return "wildcard"
    except ValueError:
        try:
            found = [ipaddress.ip_address(a.split("%", 1)[0]) for a in (resolve(host) if resolve else [])]
        except (OSError, ValueError):
            found = []
    if not found:
        return "unresolved"
    for name in ("loopback", "private", "global"):
        held = [getattr(a, f"is_{name}") for a in found]
        if all(held):
            return "public" if name == "global" else name
        if name == "loopback" and any(held):
            return "mixed"
    return "mixed"


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, text as it is; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def clean_metadata(value: object, most: int = 256, depth: int = 8) -> object:
    """Control characters out of every text, texts and lists cut at the display limit, nesting beyond ``depth`` dropped; other types as text."""
    if isinstance(value, str):
        return "".join(c for c in value if c >= " " and c != "\x7f")[:most]
    if value is None or isinstance(value, bool | int | float):
        return value
    if depth <= 0:
        return None
    if isinstance(value, dict):
        return {str(clean_metadata(str(k), most)): clean_metadata(v, most, depth - 1) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [clean_metadata(v, most, depth - 1) for v in value[:most]]
    return clean_metadata(str(value), most)
