"""Cutting lineage by written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a context: their Python needn't have it on its path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))  # copied into Spark's own file server, so the folder may be the driver's
    sc._tessella_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place all executors share (spark.checkpoint.dir), removed when the driver's JVM ends.

    A folder given to setCheckpointDir serves too. Only where there is neither a temporary folder is used, and only with a
    local master: elsewhere executors would write to disks of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or getattr(sc, "_tessella_scratch", None)
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc._tessella_scratch = "file://" + tempfile.mkdtemp(prefix="tessella-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage ends there, and nothing is computed twice."""
    path = scratch(df.sparkSession, name) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
