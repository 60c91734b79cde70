"""Report tables (the data behind each figure; nothing is drawn):
R1 top_importances, R2 correlation_triangle, R3 segment_map_table, R4 confusion_table,
R5 top_missing, R6 profile_radar, R7 outlier_map_table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.operators.evaluate import confusion_matrix
from lookalike.operators.project import attach_scores, exclude_regions, relabel


def top_importances(importances: DataFrame, n: int | None = None, labels: dict | None = None,
                    cfg: AnalysisConfig = DEFAULT, value: str = "importance") -> DataFrame:
    """The n largest importances (ties by name), with a readable label."""
    n = n or cfg.top_n
    w = Window.orderBy(F.col(value).desc(), F.col("feature"))
    top = importances.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    return relabel(top, "feature", labels or {}, out="label")


def correlation_triangle(corr: DataFrame, top: DataFrame) -> DataFrame:
    """R2: correlations among the ranked top features, strictly lower triangle (rank a > rank b)."""
    ra = top.select(F.col("feature").alias("feature_a"), F.col("rank").alias("rank_a"))
    rb = top.select(F.col("feature").alias("feature_b"), F.col("rank").alias("rank_b"))
    return (corr.join(ra, "feature_a").join(rb, "feature_b")
            .filter(F.col("rank_a") > F.col("rank_b"))
            .select("feature_a", "feature_b", "rank_a", "rank_b", "r"))


def segment_map_table(df: DataFrame, regions=None, region_col: str = "region", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Id, region, segment (and geometry when present) for the regions P4 keeps."""
    cols = ["entity_id", region_col, "segment"] + (["geometry"] if "geometry" in df.columns else [])
    return exclude_regions(df, regions, region_col, cfg).select(*cols)


def confusion_table(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The dense confusion matrix with segments numbered from 1."""
    return confusion_matrix(pred, label, prediction, offset=1)


def top_missing(profile: DataFrame, n: int | None = None, labels: dict | None = None,
                cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The n features with the most missing values, as a fraction, with a readable label."""
    n = n or cfg.top_n
    w = Window.orderBy(F.col("missing_count").desc(), F.col("feature"))
    top = (profile.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
           .select("rank", "feature", (F.col("missing_percent") / 100.0).alias("missing_fraction")))
    return relabel(top, "feature", labels or {}, out="label")


def profile_radar(profiles: DataFrame, n: int | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """The n features whose segment means vary most (sample variance across segments),
    min-max normalized per feature across segments; a zero range gives NULL.
    Input: long A9 (segment, feature, mean)."""
    n = n or cfg.radar_features
    spread = profiles.groupBy("feature").agg(F.var_samp("mean").alias("spread"))
    w = Window.orderBy(F.col("spread").desc(), F.col("feature"))
    top = spread.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    mm = profiles.groupBy("feature").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    j = profiles.join(top, "feature").join(mm, "feature")
    return j.select("rank", "feature", "segment", "mean",
                    F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo")).alias("normalized"))


def outlier_map_table(entities: DataFrame, scores: DataFrame, regions=None, region_col: str = "region",
                      cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Entities kept by P4, left-joined with their outlier scores."""
    kept = exclude_regions(entities, regions, region_col, cfg).select("entity_id", region_col)
    return attach_scores(kept, scores)
