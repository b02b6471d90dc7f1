"""What the operators share: scratch space, written cut points, ordered partitions."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.materialize import scratch, ship, width, written  # noqa: F401

#: Rows and bytes that cross to Python at once: a batch of long texts ends at whichever comes first, after one text at least.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
#: Stands for a null key in sort order: before every other key.
NULL_KEY = -(2**63)
_REMEMBERED: list[dict] = []


def remembered() -> dict:
    """A map that stays in a worker process after its task, until a task calls ``forget``."""
    _REMEMBERED.append(own := {})
    return own


def forget() -> None:
    """Frees what earlier tasks left in ``remembered`` maps: the same worker processes serve all operators, and count to the executor's memory."""
    if any(_REMEMBERED):
        for kept in _REMEMBERED:
            kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read with Arrow batches small enough for long texts, and the package shipped to the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(df: DataFrame, key: str, lookahead: bool = False, parts: int | None = None) -> DataFrame:
    """Rows placed so that partition ids ascend with ``key`` (nulls first), sorted inside each partition.

    Adds ``_part`` and ``_ahead``. Cut points are quantiles of the narrow key column, so the driver holds one number a
    partition. With ``lookahead`` the first rows of each partition are repeated at the end of the one before it, and the
    very first at the end of the last (``_ahead`` 1): a streaming reader then knows the successor of every row.
    Ties of ``key`` are ordered by text.
    """
    parts = parts or width(df.sparkSession)
    ids = df.select(F.col(key).cast("long").alias("k")).where("k is not null")
    cuts = np.array(sorted(set(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts) or [])), dtype="float64") if parts > 1 else np.array([])
    place = T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("a", T.IntegerType())]))

    def part_of(k: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, k.to_numpy(dtype="float64"), side="right")

    firsts: dict[int, list[int]] = {}
    keyed = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)))
    if lookahead:
        number = F.pandas_udf(lambda k: pd.Series(part_of(k).astype("int32")), T.IntegerType())
        found = sorted(keyed.select("_k", number("_k").alias("p")).groupBy("p").agg(F.min("_k").alias("k")).collect())
        for i, (_, k) in enumerate(found):
            firsts.setdefault(k, []).append(found[i - 1][0])

    def places(k: pd.Series) -> pd.Series:
        return pd.Series([[(int(p), 0), *((b, 1) for b in firsts.get(int(x), ()))] for x, p in zip(k, part_of(k), strict=True)])

    at = F.explode(F.pandas_udf(places, place)("_k")).alias("_at")
    out = keyed.select("*", at).select("*", F.col("_at.p").alias("_part"), F.col("_at.a").alias("_ahead")).drop("_at")
    ties = ["text"] if "text" in df.columns else []
    return out.repartitionById(parts, "_part").sortWithinPartitions("_part", "_ahead", "_k", *ties).drop("_k")


def texts(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Arrow batches as Python lists; a null ``text`` counts as empty."""
    for b in batches:
        if b.num_rows:
            yield tuple([x or "" for x in b.column(n).to_pylist()] if n in ("text", "html") else b.column(n).to_pylist() for n in names)
