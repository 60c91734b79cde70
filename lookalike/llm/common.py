"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.session import ensure_checkpoint_dir, ship_package

#: Texts of one Arrow batch are handled in slices of at most this many bytes, so that very long
#: texts bound the memory of a Python task whatever the batch size.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package for the Python workers (idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """URI of a new folder below the shared checkpoint folder; executors and driver all see it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file://" + base[len("file:"):]
    elif base.startswith("/"):
        base = "file://" + base
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_partitions(df: DataFrame, column: str) -> DataFrame:
    """Hash partitioning on ``column`` over the session's shuffle partitions (a fixed count, so
    that adaptive execution does not merge few bytes that need much work into one task)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, column)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most about ``limit`` bytes per slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        each = max(1, batch.column(column).nbytes // n)
        step = max(1, limit // each)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
