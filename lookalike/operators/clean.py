"""Cleaning: P2 drop_sparse_features, P3 drop_low_variance, C1 split_by_missing, C4 median_fill,
C5 iqr_bounds, C6 winsorize_iqr, C7 outlier_flags, C8 anomalous_entities,
C10 robust_rescale_extremes.

Decisions (which features to drop, the bounds) are one small aggregate each; applying them is
a narrow projection.  Fitted bounds are returned as frames so they can be applied to other data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.functions.quantiles import quantiles
from lookalike.operators.profile import _per_feature


def missing_shares(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, missing_share) for every feature in one aggregate."""
    return _per_feature(df, features, lambda f: F.struct(
        F.lit(f).alias("feature"),
        (F.count(F.when(F.col(f).isNull(), 1)) / F.count(F.lit(1))).alias("missing_share")))


def sparse_features(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """P2 decision: features whose missing share is strictly above the limit."""
    return missing_shares(df, features).filter(F.col("missing_share") > cfg.max_missing_share)


def drop_sparse_features(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT):
    """Returns (narrower DataFrame, kept features)."""
    drop = {r["feature"] for r in sparse_features(df, features, cfg).collect()}
    kept = [f for f in features if f not in drop]
    return df.drop(*drop), kept


def low_variance_features(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """P3 decision: sample variance (NULLs ignored) below the limit; a NULL variance is kept."""
    v = _per_feature(df, features, lambda f: F.struct(F.lit(f).alias("feature"), F.var_samp(f).alias("variance")))
    return v.filter(F.col("variance") < cfg.min_variance)


def drop_low_variance(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT):
    drop = {r["feature"] for r in low_variance_features(df, features, cfg).collect()}
    kept = [f for f in features if f not in drop]
    return df.drop(*drop), kept


def split_by_missing(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """(feature, missing_share, method) with method 'knn' below the boundary, else 'iterative'."""
    return missing_shares(df, features).withColumn(
        "method", F.when(F.col("missing_share") < cfg.knn_missing_share, "knn").otherwise("iterative"))


def median_fill(df: DataFrame, features: list[str], approx: bool = False) -> DataFrame:
    """C4: NULL → column median (exact linear-interpolated percentile by default)."""
    if not features:
        return df
    meds = quantiles(df, features, [0.5], approx)
    return df.select(*[
        F.coalesce(F.col(c), F.lit(meds[c][0])).alias(c) if c in features and meds.get(c) is not None
        else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class IqrBounds:
    bounds: dict  # feature -> (q1, q3, lower, upper)

    def winsorize(self, df: DataFrame) -> DataFrame:
        """Cap at the bounds; NULL stays NULL."""
        cols = []
        for c in df.columns:
            if c in self.bounds:
                _, _, lo, hi = self.bounds[c]
                x = F.col(c)
                cols.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(c))
            else:
                cols.append(F.col(f"`{c}`"))
        return df.select(*cols)

    def flag_columns(self):
        return [(F.when((F.col(f) < lo) | (F.col(f) > hi), 1).otherwise(0)).alias(f"flag_{f}")
                for f, (_, _, lo, hi) in self.bounds.items()]


def fit_iqr(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT, approx: bool = False) -> IqrBounds:
    if not features:
        return IqrBounds({})
    qs = quantiles(df, features, [0.25, 0.75], approx)
    k = cfg.iqr_factor
    out = {}
    for f in features:
        if qs.get(f) is None:
            continue
        q1, q3 = qs[f]
        out[f] = (q1, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return IqrBounds(out)


def iqr_bounds(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT, approx: bool = False,
               bounds: IqrBounds | None = None) -> DataFrame:
    """(feature, q1, q3, lower, upper, n_outliers, outlier_percent) — quartiles in one
    aggregate, counts in a second one that uses them as literals."""
    b = bounds or fit_iqr(df, features, cfg, approx)
    if not b.bounds:
        return df.sparkSession.createDataFrame([], "feature string, q1 double, q3 double, lower double, "
                                                   "upper double, n_outliers long, outlier_percent double")
    return _per_feature(df, list(b.bounds), lambda f: F.struct(
        F.lit(f).alias("feature"), F.lit(b.bounds[f][0]).alias("q1"), F.lit(b.bounds[f][1]).alias("q3"),
        F.lit(b.bounds[f][2]).alias("lower"), F.lit(b.bounds[f][3]).alias("upper"),
        F.count(F.when((F.col(f) < b.bounds[f][2]) | (F.col(f) > b.bounds[f][3]), 1)).alias("n_outliers"),
        (F.count(F.when((F.col(f) < b.bounds[f][2]) | (F.col(f) > b.bounds[f][3]), 1)) * 100.0
         / F.count(F.lit(1))).alias("outlier_percent")))


def winsorize_iqr(df: DataFrame, features: list[str], bounds: IqrBounds | None = None,
                  cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """C6."""
    return (bounds or fit_iqr(df, features, cfg)).winsorize(df)


def outlier_flags(df: DataFrame, features: list[str], bounds: IqrBounds | None = None,
                  cfg: AnalysisConfig = DEFAULT, keep: list[str] = ("entity_id",)) -> DataFrame:
    """0/1 per cell (before capping), the number flagged and the share of features flagged."""
    b = bounds or fit_iqr(df, features, cfg)
    flags = b.flag_columns()
    total = sum((F.col(f"flag_{f}") for f in b.bounds), F.lit(0))
    return df.select(*keep, *flags).withColumn("n_flags", total).withColumn(
        "total_pct", F.col("n_flags") * 100.0 / F.lit(len(features)))


def anomalous_entities(df: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT,
                       ids: list[str] = ("entity_id",), bounds: IqrBounds | None = None) -> DataFrame:
    """Rows with more than ``anomalous_row_share`` % of features flagged → ids + capped values.
    Flags and capped values come from the same row, so no join is needed."""
    b = bounds or fit_iqr(df, features, cfg)
    total = sum((F.when((F.col(f) < lo) | (F.col(f) > hi), 1).otherwise(0)
                 for f, (_, _, lo, hi) in b.bounds.items()), F.lit(0))
    flagged = df.withColumn("_pct", total * 100.0 / F.lit(len(features))).filter(
        F.col("_pct") > cfg.anomalous_row_share)
    capped = b.winsorize(flagged.drop("_pct"))
    return capped.select(*ids, *features)


def robust_rescale_extremes(df: DataFrame, scores: DataFrame, features: list[str], threshold: float | None = None,
                            cfg: AnalysisConfig = DEFAULT, score_col: str = "score") -> DataFrame:
    """Rows whose score is below the threshold get (x - median) / IQR, where median and
    IQR are computed among those rows only; other rows pass through unchanged."""
    tagged = df.join(scores.select("entity_id", F.col(score_col).alias("_score")), "entity_id", "left")
    return rescale_scored(tagged, df.columns, features, threshold, cfg, "_score")


def rescale_scored(tagged: DataFrame, columns: list[str], features: list[str], threshold: float | None = None,
                   cfg: AnalysisConfig = DEFAULT, score_col: str = "score") -> DataFrame:
    """C10 on rows that carry their score; returns ``columns``."""
    t = cfg.extreme_score if threshold is None else threshold
    is_ext = F.col(score_col) < F.lit(t)
    row = quantiles(tagged.filter(is_ext), features, [0.25, 0.5, 0.75])
    cols = []
    for c in columns:
        q = row.get(c) if c in features else None
        if q is None:
            cols.append(F.col(f"`{c}`"))
            continue
        iqr = q[2] - q[0]
        scaled = (F.col(c) - F.lit(q[1])) / F.lit(iqr if iqr != 0 else 1.0)
        cols.append(F.when(is_ext, scaled).otherwise(F.col(c)).alias(c))
    return tagged.select(*cols)
