"""Sources: S1 read_entities, S3 ingest_gzip_text, S4 read_artifact, S5 read_geojson, S6 integrate_sources.

(S2, GeoPackage folders, lives in ``lookalike.sources.geopackage``.)
"""

from __future__ import annotations

import os
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.functions.columns import nan_to_null


class EmptySourceError(ValueError):
    """The source exists but holds no rows."""


class MissingSourceError(FileNotFoundError):
    """The source path does not exist."""


_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet input table.  The DataFrame (plan + file index, not data) is reused per session
    so repeated queries do not list files and read footers again; inputs are read-only."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    per_session = _TABLES.setdefault(spark, {})
    if path not in per_session:
        per_session[path] = spark.read.parquet(path)
    return per_session[path]


def _infer_format(path: str) -> str:
    p = path.rstrip("/").lower()
    for ext, fmt in ((".parquet", "parquet"), (".csv", "csv"), (".json", "json"), (".jsonl", "json"),
                     (".geojson", "json"), (".orc", "orc")):
        if p.endswith(ext):
            return fmt
    return "parquet"


def read_entities(spark: SparkSession, path: str, *, fmt: str | None = None, schema: T.StructType | None = None,
                  id_col: str | None = None, check_empty: bool = True, **options) -> DataFrame:
    """Load the wide entity table; NaN → NULL on every floating column; typed errors.

    ``id_col`` renames the key to ``entity_id`` (required by every later operator).
    The emptiness check is one ``LIMIT 1`` probe, not a count.
    """
    fmt = fmt or _infer_format(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path) and not any(ch in path for ch in "*?["):
        raise MissingSourceError(path)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if id_col and id_col != "entity_id":
        df = df.withColumnRenamed(id_col, "entity_id")
    df = df.select(*[
        nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
    if check_empty and df.isEmpty():
        raise EmptySourceError(path)
    return df


def describe_source(df: DataFrame) -> DataFrame:
    """Row count, column count and column list as one row (the load report)."""
    cols = df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_columns"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"))


def read_artifact(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Re-read a written result with an explicit schema (ids stay strings, leading zeros kept)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", "true").csv(path)
    return reader.format(fmt).load(path)


def ingest_gzip_text(spark: SparkSession, path: str, out: str | None = None, partitions: int | None = None):
    """S3: expand gzip text so later scans split it.

    gzip is not splittable, so the read is one task per file; ``repartition`` spreads
    the lines before the parquet write. Returns (DataFrame of lines, written path or None).
    The output name removes the ``.gz`` *suffix* only.
    """
    lines = spark.read.text(path)
    if partitions:
        lines = lines.repartition(partitions)
    if out is None:
        base = path[:-3] if path.endswith(".gz") else path
        out = base + ".parquet" if base != path else None
    if out:
        lines.write.mode("overwrite").parquet(out)
        return spark.read.parquet(out), out
    return lines, None


def preview_lines(lines: DataFrame, n: int = 5) -> DataFrame:
    """First n stripped lines (the preview is a limit by design)."""
    return lines.select(F.trim("value").alias("value")).limit(n)


def read_geojson(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """GeoJSON features → properties struct + geometry kept as a JSON string.

    Line-delimited features are read with ``spark.read.text`` + ``from_json`` (splittable);
    a FeatureCollection document with ``multiLine`` + ``explode``.
    """
    if multiline:
        doc = spark.read.option("multiLine", "true").json(path)
        feats = doc.select(F.explode("features").alias("f"))
        return feats.select(F.col("f.properties").alias("properties"),
                            F.to_json("f.geometry").alias("geometry"))
    text = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    sample_schema = "type string, properties map<string,string>, geometry string"
    parsed = text.select(F.from_json("value", sample_schema).alias("f"))
    return parsed.select(F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


class DuplicateKeyError(ValueError):
    pass


def integrate_sources(spine: DataFrame, sources: dict[str, DataFrame], key: str = "entity_id",
                      check_unique: bool = True) -> DataFrame:
    """Successive left equi-joins from the spine, each source's columns prefixed.

    The uniqueness check is an aggregate (`count` vs `count(distinct key)`), one small
    row per source, so a fan-out join is refused before it multiplies rows.
    """
    out = spine
    for name, src in sources.items():
        if check_unique:
            row = src.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
            if row["n"] != row["d"]:
                raise DuplicateKeyError(f"source {name!r} has {row['n'] - row['d']} duplicate {key} rows")
        renamed = src.select(F.col(key), *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in src.columns if c != key])
        out = out.join(renamed, key, "left")
    return out
