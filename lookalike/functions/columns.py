"""Schema walking and wide/long reshaping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_COL = "entity_id"
RESERVED = {"entity_id", "region", "segment", "geometry", "name"}


def feature_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Every numeric column that is not an id, region, segment or geometry, in schema order."""
    skip = set(RESERVED) | set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def nan_to_null(c: str | Column) -> Column:
    """NaN is not a missing marker in Spark; make NULL the only one."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col.cast("double"))


def unpivot_features(df: DataFrame, ids: list[str], features: list[str], name: str = "feature",
                     value: str = "value") -> DataFrame:
    """Wide → long (id…, feature, value) with `stack`; one narrow projection, no shuffle."""
    if not features:
        raise ValueError("no features to unpivot")
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ids, features, name, value)


def long_to_wide_names(prefix: str, values: Iterable) -> list[str]:
    return [f"{prefix}{v}" for v in values]
