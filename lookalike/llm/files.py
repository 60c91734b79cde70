"""Flat binary files in the shared folder, written and read by the tasks themselves.

Spark has no writer or splittable reader for raw binary files; tasks open them through Arrow's
file systems by URI.  Every attempt of a task writes a file of its own name and only reports it when
done; the report of the attempts that counted is kept, so files of lost attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_output(folder: str, suffix: str):
    """(path within the file system, stream) of a new file in ``folder`` (a URI)."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None)


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def byte_ranges(files: DataFrame, block_bytes: int) -> DataFrame:
    """(file, bytes, block, start, stop) for every ``block_bytes`` of each file, dealt to the
    session's partitions.  ``files``: file, bytes."""
    spark: SparkSession = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = (files.where(F.col("bytes") > 0)
              .select("file", "bytes", F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
              .withColumn("start", F.col("block") * block_bytes)
              .withColumn("stop", F.least(F.col("start") + block_bytes, F.col("bytes"))))
    return blocks.repartition(n, F.xxhash64("file", "block"))
