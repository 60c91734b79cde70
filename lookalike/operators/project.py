"""P1 split_columns, P4 exclude_regions, P5 relabel, and the J1–J3 key joins."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.config import DEFAULT, AnalysisConfig

ID_NAMES = ("entity_id", "name", "region", "segment")
GEOMETRY = "geometry"


def split_columns(df: DataFrame, ids: tuple[str, ...] = ID_NAMES, geometry: str = GEOMETRY) -> dict[str, list[str]]:
    """Id / feature / geometry / other columns, by name and type (a schema walk)."""
    out = {"id": [], "feature": [], "geometry": [], "other": []}
    for f in df.schema.fields:
        if f.name in ids:
            out["id"].append(f.name)
        elif f.name == geometry:
            out["geometry"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out["feature"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def feature_matrix(df: DataFrame, ids: tuple[str, ...] = ID_NAMES) -> DataFrame:
    """The key plus every feature column, features cast to double (what later stages consume)."""
    parts = split_columns(df, ids)
    return df.select("entity_id", *[F.col(f).cast("double").alias(f) for f in parts["feature"]])


def exclude_regions(df: DataFrame, regions=None, column: str = "region", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Drop rows whose region is in the set; NULL regions are kept; no region column → a
    warning and the rows unchanged."""
    if column not in df.columns:
        warnings.warn(f"exclude_regions: no column {column!r}; rows passed through unchanged", stacklevel=2)
        return df
    regions = list(cfg.excluded_regions if regions is None else regions)
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(regions))


def relabel(df: DataFrame, column: str, mapping, out: str | None = None) -> DataFrame:
    """P5: code → label, unknown codes unchanged.

    ``mapping`` is a dict (inlined as a map literal) or a DataFrame(code, label), which is
    left-joined so its size is up to the planner (broadcast only under the size threshold).
    """
    out = out or column
    if isinstance(mapping, dict):
        if not mapping:
            return df.withColumn(out, F.col(column).cast("string"))
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return df.withColumn(out, F.coalesce(m[F.col(column)], F.col(column).cast("string")))
    lab = mapping.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    joined = df.join(lab, df[column] == lab["_code"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_label"), F.col(column).cast("string"))).drop("_code", "_label")


class KeyMismatchError(ValueError):
    pass


def attach_labels(df: DataFrame, labels: DataFrame, label_col: str = "segment", check: bool = True) -> DataFrame:
    """Inner equi-join on entity_id, asserted 1:1 (every row keeps exactly one label)."""
    if check:
        row = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("d")).first()
        if row["n"] != row["d"]:
            raise KeyMismatchError(f"labels hold {row['n'] - row['d']} duplicate entity_id rows")
    base = df.drop(label_col) if label_col in df.columns else df
    return base.join(labels.select("entity_id", label_col), "entity_id", "inner")


def attach_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Keep every entity, add the score columns (left equi-join)."""
    return df.join(scores, "entity_id", "left")


def attach_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Id columns beside the feature columns of selected rows (inner join on entity_id)."""
    return ids.join(rows, "entity_id", "inner")
