"""Feedback on answers: decayed votes, verdicts, latest questions, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decay(date: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """A half per half-life; 1.0 for no date or a future one."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", date, now) / 86_400e6)
    return F.when(date.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def sign(outcome: Column) -> Column:
    return F.when(outcome == "useful", 1).when(outcome.isin("dead_end", "corrected"), -1).otherwise(0)


def lessons(docs: DataFrame, now: Column, half_life_days: float = 30.0, corroborated: int = 2, known: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """node, pos, neg, score, verdict for every cited node with a vote (per group of the columns ``by``).

    ``docs``: date, outcome, source_nodes. A node counts once a document. Votes both ways: contested, and useful, dead end or
    even by the score; only for: preferred if corroborated, else tentative; only against: left out.
    """
    by = by or []
    s = sign(F.col("outcome"))
    e = docs.select(*by, "date", s.alias("s"), F.explode(F.array_distinct("source_nodes")).alias("node")).where("s <> 0 and node is not null")
    if known is not None:
        e = e.join(known.select(F.explode(F.array("id", "label")).alias("node")).distinct(), "node", "left_semi")
    g = e.groupBy(*by, "node").agg(F.count(F.when(F.col("s") > 0, 1)).alias("pos"), F.count(F.when(F.col("s") < 0, 1)).alias("neg"), F.round(F.sum(F.col("s") * decay(F.col("date"), now, half_life_days)), 9).alias("score"), F.max("date").alias("last"))
    both = F.when(F.col("score") > 0, "contested: useful").when(F.col("score") < 0, "contested: dead end").otherwise("contested: even")
    return g.where("pos > 0").withColumn("verdict", F.when(F.col("neg") > 0, both).when(F.col("pos") >= corroborated, "preferred").otherwise("tentative"))


def latest(items: DataFrame, question: str = "question", pos: str = "pos") -> DataFrame:
    """One row per question: the last."""
    w = Window.partitionBy(question).orderBy(F.desc(pos))
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def plurality(docs: DataFrame, home: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, community: the commonest community of its cited nodes (ties: the smaller name), Uncategorized without any.

    ``docs``: doc, source_nodes; ``home``: node, community.
    """
    e = docs.select(doc, F.explode(F.array_distinct("source_nodes")).alias("node")).join(home, "node")
    n = e.groupBy(doc, "community").agg(F.count("*").alias("n")).groupBy(doc).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m"))
    return docs.select(doc).join(n, doc, "left").select(doc, F.coalesce("m.community", F.lit("Uncategorized")).alias("community"))


def provenance(docs: DataFrame, most: int = 5) -> DataFrame:
    """node, and its most recent useful or corrected documents (date and question falling)."""
    e = docs.where("outcome in ('useful', 'corrected')").select("date", "question", "outcome", F.explode(F.array_distinct("source_nodes")).alias("node"))
    w = Window.partitionBy("node").orderBy(F.desc("date"), F.desc("question"))
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def canonical_nodes(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """cited, id: the node of that id, else the only one of that label, else null."""
    label = nodes.groupBy(F.col("label").alias("_l")).agg(F.min("id").alias("_by"), F.max("id").alias("z")).where("_by = z").drop("z")
    j = cited.select("cited").distinct().join(nodes.select(F.col("id").alias("_i")).distinct(), F.col("cited") == F.col("_i"), "left").join(label, F.col("cited") == F.col("_l"), "left")
    return j.select("cited", F.coalesce("_i", "_by").alias("id"))


def overlay(verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, status per node: of its citations by id or label the first of preferred, contested, tentative."""
    names = canonical_nodes(verdicts.select(F.col("node").alias("cited")), nodes).where("id is not null")
    order = F.when(F.col("verdict") == "preferred", 0).when(F.col("verdict").startswith("contested"), 1).otherwise(2)
    return names.join(verdicts, F.col("cited") == F.col("node")).groupBy("id").agg(F.min_by("verdict", F.struct(order, "node")).alias("status"))


def stale(marked: DataFrame, files: DataFrame) -> DataFrame:
    """Marked rows and whether their file's hash has changed or the file is gone. ``marked``: id, source_file, code_hash; ``files``: path, hash."""
    j = marked.join(files.select(F.col("path").alias("source_file"), F.col("hash").alias("_h")), "source_file", "left")
    return j.withColumn("stale", ~F.coalesce(F.col("_h") == F.col("code_hash"), F.lit(False))).drop("_h")


def parse_memory(text: Column) -> Column:
    """Front matter of a saved answer as a struct: date, question, outcome, correction, source_nodes."""
    head = F.regexp_extract(text, r"^---\r?\n((?s:.*?))\r?\n---", 1)
    one = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1), r'^"|"$', "")), F.lit(""))
    listed = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^source_nodes:[ \t]*\[(.*)\]", 1), F.lit(r'"([^"]*)"'), 1)
    return F.struct(F.try_to_timestamp(one("date")).alias("date"), one("question").alias("question"), one("outcome").alias("outcome"), one("correction").alias("correction"), listed.alias("source_nodes"))
