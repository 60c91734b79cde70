"""Profiles: A1 missing_profile, A2 missing_summary, A3 quality_report, A4 describe_features,
A5 correlation_matrix, A6 high_correlations, A7 extreme_correlations, A8 prune_correlated,
A16 box_summary.

Every profile is an aggregate over all features (one scan per CHUNK features), returning
a single row that is reshaped with ``inline``/``unpivot`` into a long per-feature frame.
Correlations add up all products in one scan.  No profile scans the table once per feature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.functions.quantiles import quantiles
from lookalike.functions.stats import kurt_from_moments, skew_from_moments

CHUNK = 50  # features per aggregate: keeps generated code and percentile buffers bounded


def _chunks(xs: list, n: int = CHUNK):
    for i in range(0, len(xs), n):
        yield xs[i:i + n]


def _per_feature(df: DataFrame, features: list[str], build) -> DataFrame:
    """Run ``build(feature) -> struct`` for every feature inside one aggregate per chunk
    and explode the 1-row result into one row per feature."""
    if not features:
        # no feature left (all dropped upstream): same schema, zero rows
        empty = df.limit(0).select(F.lit(None).cast("double").alias("_none_"))
        return empty.agg(F.array(build("_none_")).alias("s")).select(F.inline("s")).filter(F.lit(False))
    parts = []
    for chunk in _chunks(features):
        row = df.agg(F.array(*[build(f) for f in chunk]).alias("s"))
        parts.append(row.select(F.inline("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """A1: (feature, missing_count, missing_percent) for features with at least one NULL."""
    n = F.count(F.lit(1))
    prof = _per_feature(df, features, lambda f: F.struct(
        F.lit(f).alias("feature"),
        F.count(F.when(F.col(f).isNull(), 1)).alias("missing_count"),
        (F.count(F.when(F.col(f).isNull(), 1)) * 100.0 / n).alias("missing_percent")))
    return prof.filter(F.col("missing_count") > 0)


def missing_summary(profile: DataFrame, n_rows: int | None = None) -> DataFrame:
    """A2: min / max / mean of the A1 counts and of the percentages."""
    return profile.agg(
        F.min("missing_count").alias("min_missing"), F.max("missing_count").alias("max_missing"),
        F.avg("missing_count").alias("mean_missing"),
        F.min("missing_percent").alias("min_percent"), F.max("missing_percent").alias("max_percent"),
        F.avg("missing_percent").alias("mean_percent"))


def _lit_q(qs: dict, f: str, i: int):
    v = qs.get(f)
    return F.lit(None).cast("double") if v is None else F.lit(float(v[i]))


def quality_report(df: DataFrame, features: list[str], approx: bool = False) -> DataFrame:
    """A3: mean, median, sample std, min, max, bias-corrected skewness and excess kurtosis.
    Medians come from ``functions.quantiles`` (exact, and bounded per task on large inputs)."""
    qs = quantiles(df, features, [0.5], approx)

    def build(f):
        c = F.col(f)
        return F.struct(
            F.lit(f).alias("feature"), F.avg(c).alias("mean"), _lit_q(qs, f, 0).alias("median"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            skew_from_moments(F.count(c), F.skewness(c)).alias("skewness"),
            kurt_from_moments(F.count(c), F.kurtosis(c)).alias("kurtosis"))
    return _per_feature(df, features, build)


def describe_features(df: DataFrame, features: list[str], approx: bool = False) -> DataFrame:
    """A4: count, mean, std, min, 25/50/75 %, max, missing, missing_percent per feature."""
    qs = quantiles(df, features, [0.25, 0.5, 0.75], approx)

    def build(f):
        c = F.col(f)
        return F.struct(
            F.lit(f).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            _lit_q(qs, f, 0).alias("p25"), _lit_q(qs, f, 1).alias("p50"),
            _lit_q(qs, f, 2).alias("p75"), F.max(c).cast("double").alias("max"),
            F.count(F.when(c.isNull(), 1)).alias("missing"),
            (F.count(F.when(c.isNull(), 1)) * 100.0 / F.count(F.lit(1))).alias("missing_percent"))
    return _per_feature(df, features, build)


def _moment_sums(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over the rows where features i <= j are both present, of
    values centred on the features' means.  One scan: every task adds up d x d products and emits
    one row per pair of features."""
    means = df.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}")
                     for i, f in enumerate(features)]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    d = len(features)
    upper = np.triu_indices(d)

    def add_up(batches):
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64) - centre
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            present = known.astype(np.float64)
            n += present.T @ present
            sx += x.T @ present
            sxx += (x * x).T @ present
            sxy += x.T @ x
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": n[upper], "sx": sx[upper], "sy": sx.T[upper],
                            "sxx": sxx[upper], "syy": sxx.T[upper], "sxy": sxy[upper]})

    parts = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]).mapInPandas(
        add_up, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """A5: long (feature_a, feature_b, r, pos_a, pos_b) for every ordered pair incl. the diagonal;
    Pearson r over pairwise-complete rows (NaN counts as missing), NULL for a constant side.

    Two scans whatever the number of features: the means, then all products at once.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double, pos_a int, pos_b int")
    sums = _moment_sums(df, features)
    spread = lambda s, ss: F.col(ss) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    # values that are all equal leave nothing but rounding noise
    varies = (vx > F.lit(1e-12) * F.col("sxx")) & (vy > F.lit(1e-12) * F.col("syy")) & (F.col("n") > 1)
    r = F.when(varies, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)))
    half = sums.select("i", "j", r.alias("r"))
    both = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(f) for f in features])
    return both.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "r",
                       F.col("i").alias("pos_a"), F.col("j").alias("pos_b"))


def high_correlations(corr: DataFrame, threshold: float | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """|r| > threshold, both directions, no diagonal, strongest first."""
    t = cfg.high_r if threshold is None else threshold
    return (corr.filter((F.col("feature_a") != F.col("feature_b")) & (F.abs("r") > t))
            .select("feature_a", "feature_b", F.abs("r").alias("abs_r"))
            .orderBy(F.col("abs_r").desc(), "feature_a", "feature_b"))


def extreme_correlations(corr: DataFrame, threshold: float | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """|r| > threshold, each unordered pair once with the later column first, signed r."""
    t = cfg.extreme_r if threshold is None else threshold
    return (corr.filter((F.col("pos_a") > F.col("pos_b")) & (F.abs("r") > t))
            .select(F.col("feature_a").alias("feature1"), F.col("feature_b").alias("feature2"), "r", "pos_a",
                    "pos_b"))


def prune_correlated(df: DataFrame, extreme: DataFrame, features: list[str],
                     cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Only when more than ``prune_if_more_than`` extreme pairs exist, take the
    ``prune_pairs`` strongest and drop the lower-variance feature of each (tie → the first
    named one); returns the distinct dropped features (empty otherwise)."""
    variances = df.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.var_samp(f).alias("var"))
                                 for f in features]).alias("s")).select(F.inline("s"))
    n_pairs = extreme.count()  # a small pair list; the decision is a single number
    if n_pairs <= cfg.prune_if_more_than:
        return df.sparkSession.createDataFrame([], "feature string")
    top = (extreme.withColumn("abs_r", F.abs("r"))
           .orderBy(F.col("abs_r").desc(), F.col("pos_a"), F.col("pos_b")).limit(cfg.prune_pairs))
    v1 = variances.select(F.col("feature").alias("feature1"), F.col("var").alias("v1"))
    v2 = variances.select(F.col("feature").alias("feature2"), F.col("var").alias("v2"))
    chosen = top.join(v1, "feature1").join(v2, "feature2").select(
        F.when(F.col("v1") > F.col("v2"), F.col("feature2")).otherwise(F.col("feature1")).alias("feature"))
    return chosen.distinct()


def box_summary(df: DataFrame, features: list[str], n_features: int = 5, stage: str = "before",
                cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Quartiles and whiskers (furthest values inside Q1 - 1.5 IQR / Q3 + 1.5 IQR)
    for the first ``n_features`` features.  Two aggregates: quartiles, then whiskers."""
    feats = features[:n_features]
    qrow = quantiles(df, feats, [0.25, 0.5, 0.75])  # 3 numbers per feature
    feats = [f for f in feats if qrow.get(f) is not None]
    k = cfg.iqr_factor

    def build(f):
        q1, q2, q3 = qrow[f]
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        c = F.col(f)
        return F.struct(F.lit(f).alias("feature"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"),
                        F.lit(q3).alias("q3"),
                        F.min(F.when(c >= lo, c)).cast("double").alias("whisker_low"),
                        F.max(F.when(c <= hi, c)).cast("double").alias("whisker_high"),
                        F.count(F.when((c < lo) | (c > hi), 1)).alias("n_fliers"))
    return _per_feature(df, feats, build).withColumn("stage", F.lit(stage))


def rank_features(frame: DataFrame, by: str, n: int) -> DataFrame:
    """Top-n rows of a small per-feature frame with a rank column (ties by feature name)."""
    w = Window.orderBy(F.col(by).desc(), F.col("feature"))
    return frame.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
