"""Fitted stages: M1 pseudo_labels, M2 forest_importance, M4 pca_scores, M5 pca_loadings,
M8 kmeans_sweep, M13 assign_segments, M14 gmm_segments.

k-means fits of all k and starts share their scans (``operators.centers``).  Features enter MLlib
once as a dense vector (``VectorAssembler``, ``handleInvalid="error"``:
NULLs must be imputed first); the vector frame is cached for the repeated fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.operators import centers
from lookalike.operators.centers import CentreModel
from lookalike.operators.scale import fit_standardizer
from lookalike.operators.segments import segment_profiles

VEC = "features_vec"


def assemble(df: DataFrame, features: list[str] | str, keep: list[str] = ("entity_id",)) -> DataFrame:
    """(keep…, features_vec) from feature columns or from an array<double> column."""
    keep = [c for c in keep if c in df.columns]
    if isinstance(features, str):
        return df.select(*keep, array_to_vector(F.col(features)).alias(VEC))
    va = VectorAssembler(inputCols=list(features), outputCol=VEC, handleInvalid="error")
    return va.transform(df.select(*keep, *features)).select(*keep, VEC)


def standardized_vectors(df: DataFrame, features: list[str], keep: list[str] = ("entity_id",)) -> DataFrame:
    """Population z-scores (the reference scaler) assembled into a vector."""
    z = fit_standardizer(df, features).transform(df.select(*[c for c in keep if c in df.columns], *features))
    return assemble(z, features, keep)


@dataclass
class SweepResult:
    models: dict = field(default_factory=dict)     # k -> CentreModel (best of the starts)
    costs: dict = field(default_factory=dict)      # k -> within-cluster sum of squares

    def labels(self, vecs: DataFrame) -> DataFrame:
        """Long (k, entity_id, segment) for every fitted k."""
        return centers.labels(vecs, self.models, VEC)

    def curve(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted((int(k), float(c)) for k, c in self.costs.items()), "k int, inertia double")


def kmeans_sweep(vecs: DataFrame, ks=None, starts: int | None = None, cfg: AnalysisConfig = DEFAULT) -> SweepResult:
    """M8: for each k, the best of ``starts`` k-means++ fits (lowest cost; ties: the earliest start),
    all fitted in shared scans."""
    ks = sorted(set(ks or (*cfg.sweep_ks, *cfg.candidate_ks)))
    fitted, _ = centers.fit_all(vecs, ks, starts or cfg.kmeans_starts, cfg.seed, cfg.kmeans_iterations, VEC)
    res = SweepResult()
    for (k, s), m in sorted(fitted.items(), key=lambda t: (t[0][0], t[1].cost, t[0][1])):
        if k not in res.models:
            res.costs[k], res.models[k] = m.cost, m
    return res


def pseudo_labels(vecs: DataFrame, k: int | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """M1: KMeans(k=5, seed) labels used as classification targets."""
    k = k or cfg.pseudo_label_k
    m = kmeans_sweep(vecs, [k], 1, cfg).models[k]
    return m.transform(vecs).select("entity_id", VEC, F.col("prediction").cast("double").alias("label"))


def forest_importance(labelled: DataFrame, features: list[str], cfg: AnalysisConfig = DEFAULT,
                      label: str = "label") -> DataFrame:
    """M2: importances of a 100-tree random forest of full depth on the pseudo labels, as (feature,
    importance)."""
    # every row's node in every tree is kept between levels, not looked for from the roots again
    rf = RandomForestClassifier(numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth, seed=cfg.seed, featuresCol=VEC, labelCol=label,
                                cacheNodeIds=True)
    model = rf.fit(labelled)
    imp = model.featureImportances.toArray().tolist()
    spark = labelled.sparkSession
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))   # strongest first
    return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")


@dataclass
class PcaResult:
    model: object
    features: list
    n_components: int

    def ratios(self, spark) -> DataFrame:
        ev = self.model.explainedVariance.toArray().tolist()
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)], "component int, ratio double")

    def loadings(self, spark) -> DataFrame:
        """M5: long (feature, component, loading) for the kept components."""
        pc = self.model.pc.toArray()
        rows = [(f, j + 1, float(pc[i, j])) for i, f in enumerate(self.features) for j in range(self.n_components)]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def scores(self, vecs: DataFrame) -> DataFrame:
        """M4: (entity_id, PC1..PCn) for the kept components."""
        t = self.model.transform(vecs).select("entity_id", vector_to_array("pca").alias("p"))
        return t.select("entity_id", *[F.col("p")[j].alias(f"PC{j + 1}") for j in range(self.n_components)])


def pca_fit(vecs: DataFrame, features: list[str], share: float | None = None, cfg: AnalysisConfig = DEFAULT) -> PcaResult:
    """M4/M5/M6: PCA on standardized vectors; keeps the fewest components whose cumulative
    explained-variance ratio reaches ``share`` (the Gramian is a single tree-aggregate pass)."""
    share = cfg.variance_share if share is None else share
    full = PCA(k=len(features), inputCol=VEC, outputCol="pca").fit(vecs)   # one fit: fewer components are its first ones
    ev = full.explainedVariance.toArray()
    cum, n = 0.0, len(ev)
    for i, v in enumerate(ev):
        cum += v
        if cum >= share:
            n = i + 1
            break
    return PcaResult(full, list(features), n)


def gmm_segments(vecs: DataFrame, k: int, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Gaussian-mixture labels (declared as an option by the original analysis)."""
    m = GaussianMixture(k=k, seed=cfg.seed, featuresCol=VEC).fit(vecs)
    return m.transform(vecs).select("entity_id", F.col("prediction").cast("int").alias("segment"))


def assign_segments(df: DataFrame, model: CentreModel, vecs: DataFrame, features: list[str]):
    """Labels for one k joined to the source rows (J1), plus the segment profile.
    Returns (labelled rows, long profile)."""
    lab = model.transform(vecs).select("entity_id", F.col("prediction").cast("int").alias("segment"))
    rows = df.drop("segment").join(lab, "entity_id", "inner")
    return rows, segment_profiles(rows, features)
