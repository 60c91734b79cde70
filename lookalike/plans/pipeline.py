"""C12 preprocess, L1 run_segmentation and L2 build_report_tables.

The driver program only composes lazy DataFrames and reads back *small* decisions (which
features survive, bounds, the best k).  Entity-sized tables stay distributed; each stage
boundary that changes the schema is materialised with a reliable checkpoint so lineage stays
short and a lost executor recomputes from the checkpoint, not from the source.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.operators import (classify, clean, evaluate, graph, impute, match, ml, outliers, profile, project,
                                 report)
from lookalike.operators.segments import segment_profiles, segment_sizes
from lookalike.session import cut_lineage
from lookalike.sources import readers, writers


class StageError(RuntimeError):
    """A fatal stage (load, preprocess, cluster) failed."""


class _Skip(Exception):
    """Internal: a stage switched off by an option."""


@dataclass
class Preprocessed:
    table: DataFrame                       # entity_id + surviving features (cleaned)
    features: list
    artefacts: dict = field(default_factory=dict)


def preprocess(df: DataFrame, cfg: AnalysisConfig = DEFAULT, features: list[str] | None = None,
               isolation: bool = True, rescale_extremes: bool = True) -> Preprocessed:
    """P1 → A1 → P2 → P3 → C1..C4 → C5..C10 → A3 → A7 → A8, in that order.  Rows that the isolation forest
    finds extreme go on rescaled (C10)."""
    feats = features or project.split_columns(df)["feature"]
    number = lambda f: F.col(f).cast("double")
    table = df.select("entity_id", *[F.when(~F.isnan(number(f)), number(f)).alias(f) for f in feats])  # NaN: missing
    table = cut_lineage(table)               # the source is read once
    art = {}
    art["missing_profile"] = profile.missing_profile(table, feats)
    table, feats = clean.drop_sparse_features(table, feats, cfg)
    table, feats = clean.drop_low_variance(table, feats, cfg)
    pre = table
    split = {r["feature"]: r["method"] for r in clean.split_by_missing(pre, feats, cfg).collect()}
    knn_cols = [f for f in feats if split[f] == "knn"]
    iter_cols = [f for f in feats if split[f] == "iterative"]
    miss = pre.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in feats]).first()
    table = pre
    if knn_cols and any(miss[f] for f in knn_cols):
        table = cut_lineage(impute.knn_impute(table, knn_cols, cfg=cfg))     # searched once: what follows reads rows again
    if iter_cols:
        table = cut_lineage(impute.iterative_impute(table, iter_cols, cfg))
    table = clean.median_fill(table, feats)
    bounds = clean.fit_iqr(table, feats, cfg)
    art["iqr_bounds"] = clean.iqr_bounds(table, feats, cfg, bounds=bounds)
    art["anomalous_entities"] = clean.anomalous_entities(table, feats, cfg, bounds=bounds)
    table = bounds.winsorize(table)
    table = cut_lineage(table)
    if isolation and feats:
        # rows carry their score: ids may come twice
        scored = outliers.isolation_forest(table, feats, cfg, keep=["entity_id", *feats])
        art["isolation_forest"] = scored.select("entity_id", "outlier_score", "is_outlier")
        if rescale_extremes:
            table = clean.rescale_scored(scored, ["entity_id", *feats], feats, cfg=cfg, score_col="outlier_score")
    art["quality_report"] = profile.quality_report(table, feats)
    corr = profile.correlation_matrix(table, feats)
    extreme = profile.extreme_correlations(corr, cfg=cfg)
    art["extreme_correlations"] = extreme
    dropped = [r["feature"] for r in profile.prune_correlated(table, extreme, feats, cfg).collect()]
    feats = [f for f in feats if f not in dropped]
    table = table.select("entity_id", *feats)
    art["box_before"] = profile.box_summary(pre, [f for f in feats if f in pre.columns], stage="before", cfg=cfg)
    art["box_after"] = profile.box_summary(table, feats, stage="after", cfg=cfg)
    return Preprocessed(table, feats, art)


@dataclass
class RunResult:
    summary: DataFrame
    artefacts: dict


LOOKALIKE_METHODS = ("sampling", "nearest", "precise")


def run_segmentation(df: DataFrame, cfg: AnalysisConfig = DEFAULT, out: str | None = None,
                     grid: dict | None = None, ids: tuple[str, ...] = ("entity_id", "region", "segment"),
                     k_policy: str = "f1", features_from: str = "selected",
                     methods: tuple[str, ...] = LOOKALIKE_METHODS) -> RunResult:
    """L1: load → preprocess → statistics → feature selection → reduction → clustering →
    classifier over candidate k → attributions → look-alikes → summary.

    Load, preprocess and clustering are fatal (``StageError``); the other stages record the
    error in the artefacts and continue.  ``out`` writes every artefact as parquet.
    ``k_policy``: "f1" (best cross-validated classifier over the candidate k) or "silhouette"
    (best silhouette of the sweep).  ``features_from``: "selected" features or "pca" scores as
    the clustering input.  ``methods``: which look-alike searches run.
    """
    if k_policy not in ("f1", "silhouette") or features_from not in ("selected", "pca"):
        raise ValueError("k_policy must be f1|silhouette and features_from selected|pca")
    base = df.cache()
    try:
        return _stages(base, cfg, out, grid, ids, k_policy, features_from, methods)
    finally:
        base.unpersist()


def _stages(base: DataFrame, cfg: AnalysisConfig, out: str | None, grid: dict | None, ids: tuple[str, ...], k_policy: str,
            features_from: str, methods: tuple[str, ...]) -> RunResult:
    """The stages of ``run_segmentation`` on its cached input."""
    t0 = time.time()
    spark = base.sparkSession
    art: dict = {}
    errors: dict = {}
    metrics: dict = {}
    try:
        n_rows = base.count()
        if n_rows == 0:
            raise StageError("empty input")
    except StageError:
        raise
    except Exception as e:  # noqa: BLE001
        raise StageError(f"load: {e}") from e
    n_input = len(project.split_columns(base)["feature"])
    try:
        pre = preprocess(base, cfg)
    except Exception as e:  # noqa: BLE001
        raise StageError(f"preprocess: {e}") from e
    art.update(pre.artefacts)
    table, feats = pre.table, list(pre.features)
    art["cleaned_table"] = table
    art["columns"] = readers.describe_source(base)

    try:
        corr = profile.correlation_matrix(table, feats)
        art["describe"] = profile.describe_features(table, feats)
        art["correlation_matrix"] = corr
        art["high_correlations"] = profile.high_correlations(corr, cfg=cfg)
    except Exception as e:  # noqa: BLE001
        errors["statistics"] = str(e)

    try:
        vecs = ml.standardized_vectors(table, feats)
        lab = ml.pseudo_labels(vecs, cfg=cfg)
        imp = ml.forest_importance(lab, feats, cfg)
        art["feature_importances"] = imp
        keep = {r["feature"] for r in evaluate.select_by_cumulative(imp, cfg=cfg).collect()}
        feats = [f for f in feats if f in keep] or feats
    except Exception as e:  # noqa: BLE001
        errors["feature_selection"] = str(e)

    vecs = cut_lineage(ml.standardized_vectors(table, feats))
    try:
        pca = ml.pca_fit(vecs, feats, cfg=cfg)
        art["pca_ratios"] = pca.ratios(spark)
        art["pca_loadings"] = pca.loadings(spark)
        art["pca_scores"] = pca.scores(vecs)
        if features_from == "pca":
            pcs = [f"PC{j + 1}" for j in range(pca.n_components)]
            vecs = cut_lineage(ml.assemble(art["pca_scores"], pcs))
    except Exception as e:  # noqa: BLE001
        if features_from == "pca":
            raise StageError(f"reduction: {e}") from e
        errors["reduction"] = str(e)

    try:
        sweep = ml.kmeans_sweep(vecs, ks=(*cfg.sweep_ks, *cfg.candidate_ks), cfg=cfg)
        labels = cut_lineage(sweep.labels(vecs))
        curve = sweep.curve(spark)
        zarr = vecs.select("entity_id", ml.vector_to_array(ml.VEC).alias("features"))
        sil = evaluate.silhouette(zarr, labels.filter(F.col("k").isin(list(cfg.sweep_ks))))
        art["inertia_curve"], art["silhouette"] = curve, sil
        best_sil = evaluate.best_k_silhouette(sil).first()["k"]
        best_elbow_row = evaluate.best_k_elbow(curve.filter(F.col("k").isin(list(cfg.sweep_ks)))).first()
        art["k_choice"] = spark.createDataFrame(
            [(int(best_sil), int(best_elbow_row["k"]) if best_elbow_row else None)], "silhouette_k int, elbow_k int")
    except Exception as e:  # noqa: BLE001
        raise StageError(f"clustering: {e}") from e

    ent_ids = base.select(*[c for c in ids if c in base.columns])
    first = _keep_segments(art, labels, table, ent_ids, feats, cfg.first_k)
    try:
        art["neighbor_layout"] = cut_lineage(graph.neighbor_graph_2d(zarr))
    except Exception as e:  # noqa: BLE001
        errors["layout"] = str(e)

    best_k = cfg.first_k
    if k_policy == "silhouette":
        best_k = int(best_sil)
        if best_k not in sweep.models:
            raise StageError(f"clustering: no model for k={best_k}")
    try:
        if k_policy != "f1":
            raise _Skip()
        scores = []
        models = {}
        # one split for all k, stratified by the first k's segments: scores compare on the same rows
        shared = cut_lineage(evaluate.stratified_split(first, "segment", cfg).select("entity_id", "is_test"))
        for k in cfg.candidate_ks:
            lk = labels.filter(F.col("k") == k).select("entity_id", F.col("segment").cast("double").alias("label"))
            split = vecs.join(lk, "entity_id").join(shared, "entity_id")
            train = evaluate.stratified_folds(split.filter(~F.col("is_test")).drop("is_test"), "label", cfg)
            res = classify.grid_search(train, grid, cfg)
            models[k] = (res, split.filter(F.col("is_test")))
            scores.append((int(k), float(res.score)))
        score_df = spark.createDataFrame(scores, "k int, score double")
        art["cv_scores"] = score_df
        best_k = evaluate.best_cluster_count(score_df).first()["k"]
        res, test = models[best_k]
        pred = cut_lineage(res.model.transform(test).select(F.col("label").cast("int").alias("label"),
                                                            F.col("prediction").cast("int").alias("prediction")))
        art["accuracy_f1"] = evaluate.accuracy_f1(pred)
        metrics = art["accuracy_f1"].first().asDict()
        art["classification_report"] = evaluate.classification_report(pred)
        art["confusion_matrix"] = evaluate.confusion_matrix(pred)
        art["model_importance"] = classify.model_importance(res.model, feats, spark)
        try:
            lab_best = vecs.join(labels.filter(F.col("k") == best_k).select("entity_id"), "entity_id")
            art["class_attributions"] = cut_lineage(classify.class_attributions(res.model, lab_best, feats, cfg=cfg))
        except Exception as e:  # noqa: BLE001
            errors["attributions"] = str(e)
        if out:
            writers.save_model(res.model, f"{out}/model", {"best_params": res.params, "num_features": len(feats),
                                                           "optimal_clusters": best_k,
                                                           "tested_cluster_counts": list(cfg.candidate_ks)}, spark)
    except _Skip:
        pass
    except Exception as e:  # noqa: BLE001
        errors["classifier"] = str(e)

    _keep_segments(art, labels, table, ent_ids, feats, int(best_k))
    rows = art[f"assignments_{best_k}"]
    art["segment_sizes"] = segment_sizes(rows)
    try:
        if "region" in rows.columns:
            feat_rows = rows.join(table, "entity_id")
            if "sampling" in methods:
                art["sampled_lookalikes"] = match.sampled_lookalikes(feat_rows, cfg=cfg)
            if "nearest" in methods:
                art["nearest_lookalikes"] = match.nearest_lookalikes(feat_rows, feats, cfg=cfg)
            if "precise" in methods:
                # kept once: the summary and the report tables read the pairs again
                precise = cut_lineage(match.precise_lookalikes(feat_rows, feats, cfg=cfg))
                art["precise_lookalikes"] = precise
                art["similarity_summary"] = match.similarity_summary(precise)
    except Exception as e:  # noqa: BLE001
        errors["lookalikes"] = str(e)

    if out:
        for name, frame in art.items():
            if isinstance(frame, DataFrame):
                writers.write_artifact(frame, f"{out}/{name}")
        if "geometry" in base.columns:
            for k in sorted({cfg.first_k, int(best_k)}):
                writers.write_geojson_lines(art[f"assignments_{k}"].join(base.select("entity_id", "geometry"), "entity_id"),
                                            f"{out}/segments_{k}_geojson")
    summary = writers.run_summary(spark, {
        "runtime_seconds": round(time.time() - t0, 3), "n_input_features": n_input,
        "n_selected_features": len(feats), "n_rows": n_rows, "n_segments": int(best_k),
        "accuracy": float(metrics["accuracy"]) if metrics else float("nan"),
        "f1_weighted": float(metrics["f1_weighted"]) if metrics else float("nan"),
        "errors": ";".join(f"{k}: {v[:200]}" for k, v in sorted(errors.items())),
    })
    return RunResult(summary, art)


def _keep_segments(art: dict, labels: DataFrame, table: DataFrame, ent_ids: DataFrame, feats: list, k: int) -> DataFrame:
    """Assignments and profiles of one k, as artefacts; returns (entity_id, segment)."""
    own = labels.filter(F.col("k") == k).select("entity_id", "segment")
    art[f"segment_profiles_{k}"] = segment_profiles(table.join(own, "entity_id"), feats)
    art[f"assignments_{k}"] = ent_ids.drop("segment").join(own, "entity_id")
    return own


def build_report_tables(art: dict, importances: DataFrame | None = None, labels: dict | None = None,
                        cfg: AnalysisConfig = DEFAULT) -> dict:
    """L2: R1–R7, A10, A14, A15 from the artefacts of a run (missing ones are skipped)."""
    out = {}
    imp = importances if importances is not None else art.get("model_importance")
    if imp is not None:
        out["top_importances"] = report.top_importances(imp, labels=labels, cfg=cfg)
        if "correlation_matrix" in art:
            out["correlation_triangle"] = report.correlation_triangle(art["correlation_matrix"],
                                                                      out["top_importances"])
    assign = [v for k, v in art.items() if k.startswith("assignments_")]
    if assign:
        out["segment_map_table"] = report.segment_map_table(assign[-1], cfg=cfg)
        out["segment_sizes"] = segment_sizes(assign[-1])
    if "missing_profile" in art:
        out["top_missing"] = report.top_missing(art["missing_profile"], labels=labels, cfg=cfg)
    profs = [v for k, v in art.items() if k.startswith("segment_profiles_")]
    if profs:
        out["profile_radar"] = report.profile_radar(profs[-1], cfg=cfg)
    if "isolation_forest" in art and assign:
        out["outlier_map_table"] = report.outlier_map_table(assign[-1], art["isolation_forest"], cfg=cfg)
    if "confusion_matrix" in art:
        out["confusion_table"] = art["confusion_matrix"].select(
            (F.col("label") + 1).alias("label"), (F.col("prediction") + 1).alias("prediction"), "n")
    pairs = art.get("precise_lookalikes")
    if pairs is not None:
        out["similarity_histogram"] = match.similarity_histogram(pairs, cfg=cfg)
        out["similarity_density"] = match.similarity_density(pairs)
    return out
