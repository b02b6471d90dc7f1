"""Change requests: status, blast radius over a graph, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["CI-FAIL", "CHANGES-REQ", "READY", "APPROVED", "PENDING", "STALE", "DRAFT", "WRONG-BASE"]


def status(base: Column, expected: Column, ci: Column, review: Column, draft: Column, updated: Column, now: Column, stale_days: int = 14) -> Column:
    """The first rule that holds decides."""
    return (
        F.when(base != expected, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(F.datediff(now, updated) >= stale_days, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")
    )


def ci_state(conclusions: Column) -> Column:
    """One state of a list of check conclusions."""
    up = F.transform(F.coalesce(conclusions, F.array()), lambda c: F.upper(c))
    has = lambda *xs: F.arrays_overlap(up, F.array(*map(F.lit, xs)))
    return F.when(F.size(up) == 0, "NONE").when(has("FAILURE", "ERROR", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED"), "FAILURE").when(has("IN_PROGRESS", "QUEUED", "PENDING"), "PENDING").when(has("SUCCESS"), "SUCCESS").otherwise("NONE")


def path_tails(path: Column) -> Column:
    """All suffixes of a path that begin at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def matched_files(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """number, file of every graph file that equals a changed file or is its tail at a segment, or the other way round.

    The theta join of path tails becomes two equi-joins on exploded tails. ``requests``: number, files.
    """
    changed = requests.select("number", F.explode(F.array_distinct("files")).alias("f")).where("f is not null and f <> ''")
    known = nodes.select(F.col("source_file").alias("file")).where("file is not null and file <> ''").distinct()
    a = changed.select("number", F.explode(path_tails(F.col("f"))).alias("file")).join(known, "file").select("number", "file")
    b = changed.join(known.select("file", F.explode(path_tails(F.col("file"))).alias("f")), "f").select("number", "file")
    return a.union(b).distinct()


def impact(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """number, communities (sorted), nodes: what the changed files hold; each graph file counts once."""
    per = nodes.groupBy(F.col("source_file").alias("file"), "community").agg(F.count("*").alias("n"))
    g = matched_files(requests, nodes).join(per, "file").groupBy("number").agg(F.array_sort(F.collect_set("community")).alias("communities"), F.sum("n").alias("nodes"))
    return requests.select("number").join(g, "number", "left").select("number", F.coalesce("communities", F.array().cast("array<int>")).alias("communities"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def conflicts(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, requests of communities that more than one request touches, by pair counts rather than lists: n, first, last.

    Paths are matched once each, not once a request that has them.
    """
    changed = requests.select("number", F.explode(F.array_distinct("files")).alias("path")).where("path is not null and path <> ''")
    paths = changed.select("path").distinct()
    of_file = nodes.select(F.col("source_file").alias("file"), "community").where("community is not null").distinct()
    homes = matched_files(paths.select(F.col("path").alias("number"), F.array("path").alias("files")), nodes).join(of_file, "file").select(F.col("number").alias("path"), "community").distinct()
    hit = changed.join(homes, "path").select("number", "community").distinct()
    return hit.groupBy("community").agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last")).where("n > 1")


def triage(requests: DataFrame) -> DataFrame:
    """By how soon a request needs attention, then number. ``requests``: number, status."""
    return requests.withColumn("rank", F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))).orderBy("rank", "number")
