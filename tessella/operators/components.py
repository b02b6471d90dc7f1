"""Connected components by alternating stars, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import drop, scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of a link; works for any orderable type.

    Each round points the larger neighbours of every node at its smallest one, then does the same for the smaller ones; both
    are a grouped minimum and one equi-join, so a hub is a partial aggregate and a skew join, never a task's list. Rounds end
    when the links no longer change. Links to null or to the node itself are ignored unless the node has no other.
    """
    spark = links.sparkSession
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    stars = both.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    path = scratch(spark, "components")
    before = None
    for i in range(most_rounds):
        e = spark.read.parquet(f"{path}/{i}") if i else stars
        # only links to smaller nodes (u > v) can hold a node's smallest; without any it is its own
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large.write.parquet(f"{path}/large{i}")
        large = spark.read.parquet(f"{path}/large{i}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small.write.parquet(f"{path}/{i + 1}")
        drop(spark, f"{path}/large{i}")
        if i:
            drop(spark, f"{path}/{i}")
        state = tuple(spark.read.parquet(f"{path}/{i + 1}").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    end = spark.read.parquet(f"{path}/{i + 1}")
    roots = end.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = end.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    lone = both.where("x = y").select(F.col("x").alias("node")).distinct().join(found, "node", "left_anti")
    return found.union(lone.select("node", F.col("node").alias("component")))
