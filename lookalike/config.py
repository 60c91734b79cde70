"""Analysis defaults, in one frozen dataclass that the operators really read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


# Thresholds and counts that must equal the original analysis.
@dataclass(frozen=True)
class AnalysisConfig:
    # cleaning
    max_missing_share: float = 0.8          # drop a feature when missing share > this
    min_variance: float = 0.01              # drop a feature when sample variance < this
    knn_missing_share: float = 0.1          # < this → KNN imputation, >= → iterative
    knn_neighbors: int = 5
    iterative_rounds: int = 10
    iqr_factor: float = 1.5
    anomalous_row_share: float = 50.0       # percent of flagged features, strict >
    isolation_contamination: float = 0.05
    isolation_trees: int = 100
    isolation_sample: int = 256
    extreme_score: float = -0.5
    # correlation
    extreme_r: float = 0.95
    prune_if_more_than: int = 5
    prune_pairs: int = 5
    high_r: float = 0.8
    # selection / reduction
    forest_trees: int = 100
    forest_depth: int = 30                  # deepest tree that can be grown (the original grows until pure)
    pseudo_label_k: int = 5
    importance_share: float = 0.8
    variance_share: float = 0.8
    # clustering
    sweep_ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7)
    candidate_ks: tuple[int, ...] = (10, 11, 12)
    first_k: int = 10
    kmeans_starts: int = 10
    kmeans_iterations: int = 300
    # classifier
    test_share: float = 0.3
    folds: int = 5
    # look-alikes
    pairs_per_region_pair: int = 10
    neighbours: int = 10
    min_similarity: float = 0.0
    default_weight: float = 1.0
    feature_weights: dict = field(default_factory=dict)
    # reports
    attribution_rows: int = 1000
    histogram_bins: int = 50
    top_n: int = 10
    radar_features: int = 5
    excluded_regions: tuple[str, ...] = ("02", "15", "60", "66", "69", "72", "78")
    seed: int = 42

    def with_(self, **kw) -> "AnalysisConfig":
        return replace(self, **kw)


DEFAULT = AnalysisConfig()
