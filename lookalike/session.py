"""Session helpers: a tuned local session for tests/bench and checkpoint-dir resolution."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lookalike") -> SparkSession:
    """Session used by tests and the bench.  On a cluster, build your own session;
    every operator only relies on the public DataFrame API."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOKALIKE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting wins.
    Only a local-mode session with nothing configured (tests, bench) gets a
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="lookalike-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apply_in_groups(df: DataFrame, keys: list[str], fn, schema):
    """``groupBy(keys).applyInPandas(fn, schema)`` for compute-heavy groups, spread over tasks.

    Adaptive execution sizes partitions by *bytes*, so a few MB of vectors that feed seconds of
    NumPy work per group would be coalesced into one task.  The rows are therefore tagged with a
    hash of their group keys and hash-partitioned on that tag with an explicit
    ``repartition(n, tag)``; AQE keeps a user-specified partition count, and because the tag is a
    new expression Spark cannot drop the repartition as redundant (it would, were the input
    already partitioned by the keys, e.g. by a window).  Grouping by (tag, keys) reuses that
    partitioning.  ``n`` is the session's shuffle-partition count (sized for the cluster).
    ``fn(key_tuple, pdf)`` sees the original keys and columns.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tagged = df.withColumn("_task", F.xxhash64(*[F.col(k) for k in keys])).repartition(n, "_task")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(tuple(key[1:]), pdf.drop(columns=["_task"]))

    return tagged.groupBy("_task", *keys).applyInPandas(run, schema=schema)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lookalike`` importable in the Python workers (what ``--py-files`` does at submit
    time): zip the package once per application and register it with ``addPyFile``; Spark
    distributes it to every executor and puts it on the workers' path."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import lookalike
    root = os.path.dirname(os.path.abspath(lookalike.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="lookalike-pkg-"), "lookalike.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
