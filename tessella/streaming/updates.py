"""Incremental updates: a stream of changed records merged into a stored graph, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.merge import replace_sources


def changed_sources(existing, extractable, ignored, known):
    """State of a changed file: existing, pending, ignored or deleted; only the last two may evict its records."""
    return F.when(ignored, "ignored").when(existing & extractable, "existing").when(existing, "pending").when(known, "deleted").otherwise("pending")


class GraphTable:
    """Versions of a record table in a folder: each is whole, and a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, hp = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(hp(self.path)):
            return []
        # a version counts once its commit marker is there
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(hp(self.path)) if s.getPath().getName()[0] == "v" and fs.exists(hp(f"{s.getPath()}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        """Writing a version again replaces it: a batch that is retried after a failure gives the same table."""
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, hp = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for v in self.versions()[:-keep]:
            fs.delete(hp(f"{self.path}/v{v}"), True)


def merge_stream(changes: DataFrame, table: GraphTable, checkpoint: str, order: str = "pos", then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Starts a query that replaces, batch by batch, the records of every source file that changed (the latest by ``order`` in a batch).

    ``changes``: record columns with source_file, a boolean ``deleted`` and the order column. Batch ids name versions, so a batch
    that runs twice changes nothing; the trigger takes what is there and ends.
    """
    def batch(df: DataFrame, n: int) -> None:
        before = [v for v in table.versions() if v < n + 1]
        last = df.groupBy("source_file").agg(F.max(order).alias("_last"))
        newest = df.join(last, "source_file").where(F.col(order) == F.col("_last")).drop("_last")
        live = newest.where("not deleted").drop("deleted", order)
        if before:
            old = table.spark.read.parquet(f"{table.path}/v{before[-1]}")
            merged = replace_sources(old, live, newest.where("deleted").select("source_file"))
        else:
            merged = live
        table.write(merged, n + 1)
        if then is not None:
            then(table.read())

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quiet_groups(events: DataFrame, gap: str = "3 seconds", late: str = "1 minute", by: str = "path") -> DataFrame:
    """Bursts of changes: a group closes once nothing came for ``gap``; late events beyond the watermark are dropped by design."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("changes"), F.max("ts").alias("last"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "changes", "last")
