"""Registered queries: one per operator of the inventory, each reading the driver's tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame``.  Results are rounded only at this
boundary (``_round``) so the order-insensitive value hash against the SQL oracle is stable;
the library functions themselves return full precision.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.config import AnalysisConfig
from lookalike.functions.columns import feature_columns, unpivot_features
from lookalike.operators.boosting import BoostedModel
from lookalike.operators import (classify, clean, evaluate, graph, impute, match, ml, outliers, profile, project,
                                 report, segments)
from lookalike.plans import pipeline
from lookalike.operators.scale import fit_standardizer, weight_features
from lookalike.operators.similarity import topk_similarity
from lookalike.session import cut_lineage, ensure_checkpoint_dir
from lookalike.sources import readers, tables, writers
from lookalike.sources.tables import ENTITY_FEATURES, LINE_FEATURES, ORDER_LINE_FEATURES


# Output rounding for the order-insensitive comparison.  Values are taken as decimals; six further
# digits are rounded first, so that a sum's last bits don't decide a decimal tie (.xx5).
def _round(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = per_col.get(f.name, digits)
            exact = F.round(F.col(f.name).cast("double").try_cast("decimal(38,12)"), d + 6)
            cols.append((F.round(exact, d).cast("double") + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


MONEY = 2
EF_DIGITS = {"acctbal": MONEY, "total": MONEY, "avg_total": MONEY, "max_total": MONEY}


def _ef(spark, d):
    return tables.entity_features(spark, d)


def _long_nonnull(df: DataFrame, features: list[str]) -> DataFrame:
    return unpivot_features(df, ["entity_id"], features).filter(F.col("value").isNotNull())


# ---------------- sources / sinks ----------------

def q_read_entities(spark, d):
    df = readers.read_entities(spark, f"{d}/customer.parquet", id_col="c_custkey")
    return _round(df, c_acctbal=MONEY)


def q_integrate_sources(spark, d):
    spine = tables.customers(spark, d).select("entity_id", "region", "segment")
    orders = readers.read_table(spark, d, "orders")
    li = readers.read_table(spark, d, "lineitem")
    ord_src = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines"))
    li_src = (orders.select("o_orderkey", "o_custkey")
              .join(per_order, orders.o_orderkey == per_order.l_orderkey)
              .groupBy(F.col("o_custkey").alias("entity_id"))
              .agg(F.sum("qty").alias("quantity"), F.sum("lines").alias("lines")))
    out = readers.integrate_sources(spine, {"ord": ord_src, "li": li_src})
    return _round(out, ord_total=MONEY)


def _assignments(spark, d):
    c = tables.customers(spark, d)
    return c.select(F.col("entity_id").cast("string").alias("entity_id"),
                    F.lpad(F.col("region").cast("string"), 2, "0").alias("region_code"), "segment")


ASSIGNMENT_SCHEMA = "entity_id string, region_code string, segment string"


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/artifacts/{uuid.uuid4().hex}"


def q_export_assignments(spark, d):
    return writers.export_assignments(_assignments(spark, d), ["entity_id", "region_code"], "segment")


def q_write_artifact(spark, d):
    path = _scratch(spark)
    writers.write_artifact(_assignments(spark, d), path, fmt="csv")
    return readers.read_artifact(spark, path, ASSIGNMENT_SCHEMA)


def q_read_artifact(spark, d):
    path = _scratch(spark)
    writers.write_artifact(_assignments(spark, d), path, fmt="csv")
    return readers.read_artifact(spark, path, ASSIGNMENT_SCHEMA).filter(F.col("segment").isNotNull())


# ---------------- projections ----------------

def q_split_columns(spark, d):
    return _round(project.feature_matrix(_ef(spark, d)), **EF_DIGITS)


def q_drop_sparse_features(spark, d):
    wide = tables.entity_pivot(spark, d, "quarter")
    feats = feature_columns(wide)
    kept_df, kept = clean.drop_sparse_features(wide, feats)
    return _round(_long_nonnull(kept_df, kept), value=MONEY)


def q_drop_low_variance(spark, d):
    lf = tables.line_features(spark, d)
    kept_df, kept = clean.drop_low_variance(lf, LINE_FEATURES)
    return _round(_long_nonnull(kept_df, kept), value=MONEY)


def q_exclude_regions(spark, d):
    c = _assignments(spark, d)
    return project.exclude_regions(c, column="region_code")


SEGMENT_LABELS = {"AUTOMOBILE": "Automobile", "BUILDING": "Building", "MACHINERY": "Machinery"}


def q_relabel(spark, d):
    c = tables.customers(spark, d).select("entity_id", "segment")
    return project.relabel(c, "segment", SEGMENT_LABELS, out="segment_label").select("entity_id", "segment_label")


# ---------------- joins ----------------

def q_attach_labels(spark, d):
    ef = _ef(spark, d).drop("segment", "name")
    labels = tables.customers(spark, d).select("entity_id", "segment")
    return _round(project.attach_labels(ef, labels), **EF_DIGITS)


def _flag_scores(spark, d):
    ef = _ef(spark, d)
    flags = clean.outlier_flags(ef, ENTITY_FEATURES)
    return flags.select("entity_id", (-F.col("total_pct") / 100.0).alias("score"))


def q_attach_scores(spark, d):
    ents = tables.customers(spark, d).select("entity_id", "region")
    scores = _flag_scores(spark, d).filter(F.col("score") < 0)
    return _round(project.attach_scores(ents, scores))


def q_attach_ids(spark, d):
    ev = tables.event_values(spark, d)
    rows = clean.anomalous_entities(ev, ["value"])
    ids = readers.read_table(spark, d, "events").select(F.col("event_id").alias("entity_id"), "user_id", "event_type")
    return _round(project.attach_ids(rows, ids))


def q_rank_aligned_pairs(spark, d):
    ef = _ef(spark, d)
    return match.rank_aligned_pairs(ef, 10).select("segment", "rk", "a_id", "a_region", "b_id", "b_region")


def q_topk_similarity(spark, d):
    v = tables.vectors(spark, d)
    out = topk_similarity(v, k=5, region_rule="any", exclude_self=True)
    return _round(out.select("a_id", "b_id", "similarity"))


# ---------------- profiles ----------------

def q_missing_profile(spark, d):
    wide = tables.entity_pivot(spark, d, "year")
    return _round(profile.missing_profile(wide, feature_columns(wide)))


def q_missing_summary(spark, d):
    wide = tables.entity_pivot(spark, d, "quarter")
    return _round(profile.missing_summary(profile.missing_profile(wide, feature_columns(wide))))


def q_quality_report(spark, d):
    out = profile.quality_report(_ef(spark, d), ENTITY_FEATURES)
    return _round(out, mean=MONEY, median=MONEY, std=MONEY, min=MONEY, max=MONEY)


def q_describe_features(spark, d):
    wide = tables.entity_pivot(spark, d, "status")
    out = profile.describe_features(wide, feature_columns(wide))
    return _round(out, mean=MONEY, std=MONEY, min=MONEY, max=MONEY, p25=MONEY, p50=MONEY, p75=MONEY)


def q_correlation_matrix(spark, d):
    return _round(profile.correlation_matrix(_ef(spark, d), ENTITY_FEATURES).select("feature_a", "feature_b", "r"))


def q_high_correlations(spark, d):
    corr = profile.correlation_matrix(_ef(spark, d), ENTITY_FEATURES)
    return _round(profile.high_correlations(corr))


def q_extreme_correlations(spark, d):
    ol = tables.order_lines(spark, d)
    corr = profile.correlation_matrix(ol, ORDER_LINE_FEATURES)
    return _round(profile.extreme_correlations(corr).select("feature1", "feature2", "r"))


def q_prune_correlated(spark, d):
    ol = tables.order_lines(spark, d)
    corr = profile.correlation_matrix(ol, ORDER_LINE_FEATURES)
    return profile.prune_correlated(ol, profile.extreme_correlations(corr), ORDER_LINE_FEATURES)


def q_box_summary(spark, d):
    out = profile.box_summary(_ef(spark, d), ENTITY_FEATURES)
    return _round(out, q1=MONEY, median=MONEY, q3=MONEY, whisker_low=MONEY, whisker_high=MONEY)


# ---------------- cleaning ----------------

def q_split_by_missing(spark, d):
    st = tables.entity_pivot(spark, d, "status")
    yr = tables.entity_pivot(spark, d, "year").drop("region", "segment")
    wide = st.join(yr, "entity_id")
    return _round(clean.split_by_missing(wide, feature_columns(wide)))


def q_median_fill(spark, d):
    wide = tables.entity_pivot(spark, d, "status")
    feats = feature_columns(wide)
    filled = clean.median_fill(wide, feats)
    return _round(unpivot_features(filled, ["entity_id"], feats), value=MONEY)


def q_iqr_bounds(spark, d):
    out = clean.iqr_bounds(_ef(spark, d), ENTITY_FEATURES)
    return _round(out, q1=MONEY, q3=MONEY, lower=MONEY, upper=MONEY)


def q_winsorize_iqr(spark, d):
    ef = _ef(spark, d).select("entity_id", *ENTITY_FEATURES)
    return _round(clean.winsorize_iqr(ef, ENTITY_FEATURES), **EF_DIGITS)


def q_outlier_flags(spark, d):
    out = clean.outlier_flags(_ef(spark, d), ENTITY_FEATURES)
    return _round(out.select("entity_id", "n_flags", "total_pct"))


def q_anomalous_entities(spark, d):
    return _round(clean.anomalous_entities(tables.event_values(spark, d), ["value"]))


def q_robust_rescale_extremes(spark, d):
    ef = _ef(spark, d).select("entity_id", *ENTITY_FEATURES)
    out = clean.robust_rescale_extremes(ef, _flag_scores(spark, d), ENTITY_FEATURES, threshold=-0.15)
    return _round(out, 4)


def q_standardize(spark, d):
    ef = _ef(spark, d).select("entity_id", *ENTITY_FEATURES)
    return _round(fit_standardizer(ef, ENTITY_FEATURES).transform(ef))


# ---------------- segments ----------------

def q_segment_profiles(spark, d):
    return _round(segments.segment_profiles(_ef(spark, d), ENTITY_FEATURES), mean=MONEY)


def q_segment_sizes(spark, d):
    return segments.segment_sizes(_ef(spark, d))


def q_segment_region_counts(spark, d):
    return segments.segment_region_counts(_ef(spark, d))


def q_multi_region_segments(spark, d):
    return segments.multi_region_segments(_ef(spark, d))


# ---------------- look-alikes ----------------

def q_sampled_lookalikes(spark, d):
    return match.sampled_lookalikes(_ef(spark, d))


def q_nearest_lookalikes(spark, d):
    return _round(match.nearest_lookalikes(tables.vectors(spark, d), "features"))


def q_precise_lookalikes(spark, d):
    return _round(match.precise_lookalikes(_ef(spark, d), ENTITY_FEATURES))


FLAGSHIP_WEIGHTS = {"acctbal": 2.0, "total": 0.5}


def q_weight_features(spark, d):
    ef = _ef(spark, d).select("entity_id", *ENTITY_FEATURES)
    z = fit_standardizer(ef, ENTITY_FEATURES).transform(ef)
    return _round(weight_features(z, ENTITY_FEATURES, FLAGSHIP_WEIGHTS))


def q_similarity_summary(spark, d):
    return _round(match.similarity_summary(match.precise_lookalikes(_ef(spark, d), ENTITY_FEATURES)))


def q_similarity_histogram(spark, d):
    pairs = match.nearest_lookalikes(tables.vectors(spark, d), "features")
    return _round(match.similarity_histogram(pairs))


def q_similarity_density(spark, d):
    pairs = match.nearest_lookalikes(tables.vectors(spark, d), "features")
    return _round(match.similarity_density(pairs), 4)


# ---------------- evaluation ----------------

def _variance_shares(spark, d):
    vc = tables.vector_columns(spark, d)
    feats = [c for c in vc.columns if c.startswith("d")]
    v = profile._per_feature(vc, feats, lambda f: F.struct(F.lit(f).alias("feature"), F.var_samp(f).alias("v")))
    # one row per feature: the share is a window over this small frame, not a join
    return v.select("feature", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("importance"))


def q_select_by_cumulative(spark, d):
    return _round(evaluate.select_by_cumulative(_variance_shares(spark, d)))


def q_explained_variance_cut(spark, d):
    shares = _variance_shares(spark, d).select(
        F.expr("cast(substring(feature, 2) as int)").alias("component"), F.col("importance").alias("ratio"))
    return _round(evaluate.explained_variance_cut(shares))


def _hash_labels(spark, d, ks=(2, 3, 4, 5, 6, 7)):
    v = tables.vectors(spark, d)
    return v.select("entity_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).select(
        F.col("k").cast("int").alias("k"), "entity_id", F.pmod(F.col("entity_id"), F.col("k")).cast("int").alias("segment"))


def q_inertia_curve(spark, d):
    return _round(evaluate.inertia_curve(tables.vectors(spark, d), _hash_labels(spark, d)), 4)


def q_silhouette(spark, d):
    return _round(evaluate.silhouette(tables.vectors(spark, d), _hash_labels(spark, d)))


def q_best_k_silhouette(spark, d):
    curve = evaluate.silhouette(tables.vectors(spark, d), _hash_labels(spark, d))
    return _round(evaluate.best_k_silhouette(curve))


def q_best_k_elbow(spark, d):
    curve = evaluate.inertia_curve(tables.vectors(spark, d), _hash_labels(spark, d))
    return _round(evaluate.best_k_elbow(curve), 4)


def q_best_cluster_count(spark, d):
    acc = (tables.predictions(spark, d)
           .select(F.explode(F.array(*[F.lit(k) for k in (10, 11, 12)])).alias("k"), "label", "entity_id")
           .withColumn("prediction", F.pmod(F.col("entity_id"), F.col("k")))
           .groupBy("k").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score")))
    return _round(evaluate.best_cluster_count(acc))


def q_stratified_split(spark, d):
    p = tables.predictions(spark, d).select("entity_id", "label")
    return evaluate.stratified_split(p).select("entity_id", "label", "is_test")


def q_stratified_folds(spark, d):
    p = tables.predictions(spark, d).select("entity_id", "label")
    return evaluate.stratified_folds(p).select("entity_id", "label", "fold")


def q_accuracy_f1(spark, d):
    return _round(evaluate.accuracy_f1(tables.predictions(spark, d)))


def q_classification_report(spark, d):
    return _round(evaluate.classification_report(tables.predictions(spark, d)))


def q_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(tables.predictions(spark, d))


# ---------------- reports ----------------

DIM_LABELS = {f"d{i}": f"dimension {i}" for i in range(8)}


def q_top_importances(spark, d):
    return _round(report.top_importances(_variance_shares(spark, d), labels=DIM_LABELS))


def q_correlation_triangle(spark, d):
    vc = tables.vector_columns(spark, d)
    top = report.top_importances(_variance_shares(spark, d))
    names = [r["feature"] for r in top.select("feature").collect()]  # ten names
    corr = profile.correlation_matrix(vc, names)
    return _round(report.correlation_triangle(corr, top))


def q_segment_map_table(spark, d):
    c = _assignments(spark, d)
    return report.segment_map_table(c, region_col="region_code")


def q_confusion_table(spark, d):
    return report.confusion_table(tables.predictions(spark, d))


def q_top_missing(spark, d):
    wide = tables.entity_pivot(spark, d, "month")
    prof = profile.missing_profile(wide, feature_columns(wide))
    return _round(report.top_missing(prof, labels={"m199501": "January 1995"}))


def q_profile_radar(spark, d):
    prof = segments.segment_profiles(_ef(spark, d), ENTITY_FEATURES)
    return _round(report.profile_radar(prof), mean=MONEY)


def q_outlier_map_table(spark, d):
    c = _assignments(spark, d).withColumn("entity_id", F.col("entity_id").cast("long"))
    scores = _flag_scores(spark, d).filter(F.col("score") < 0)
    return _round(report.outlier_map_table(c, scores, region_col="region_code"))


QUERIES = {
    "read_entities": q_read_entities,
    "integrate_sources": q_integrate_sources,
    "write_artifact": q_write_artifact,
    "read_artifact": q_read_artifact,
    "export_assignments": q_export_assignments,
    "split_columns": q_split_columns,
    "drop_sparse_features": q_drop_sparse_features,
    "drop_low_variance": q_drop_low_variance,
    "exclude_regions": q_exclude_regions,
    "relabel": q_relabel,
    "attach_labels": q_attach_labels,
    "attach_scores": q_attach_scores,
    "attach_ids": q_attach_ids,
    "rank_aligned_pairs": q_rank_aligned_pairs,
    "topk_similarity": q_topk_similarity,
    "missing_profile": q_missing_profile,
    "missing_summary": q_missing_summary,
    "quality_report": q_quality_report,
    "describe_features": q_describe_features,
    "correlation_matrix": q_correlation_matrix,
    "high_correlations": q_high_correlations,
    "extreme_correlations": q_extreme_correlations,
    "prune_correlated": q_prune_correlated,
    "box_summary": q_box_summary,
    "split_by_missing": q_split_by_missing,
    "median_fill": q_median_fill,
    "iqr_bounds": q_iqr_bounds,
    "winsorize_iqr": q_winsorize_iqr,
    "outlier_flags": q_outlier_flags,
    "anomalous_entities": q_anomalous_entities,
    "robust_rescale_extremes": q_robust_rescale_extremes,
    "standardize": q_standardize,
    "segment_profiles": q_segment_profiles,
    "segment_sizes": q_segment_sizes,
    "segment_region_counts": q_segment_region_counts,
    "multi_region_segments": q_multi_region_segments,
    "sampled_lookalikes": q_sampled_lookalikes,
    "nearest_lookalikes": q_nearest_lookalikes,
    "precise_lookalikes": q_precise_lookalikes,
    "weight_features": q_weight_features,
    "similarity_summary": q_similarity_summary,
    "similarity_histogram": q_similarity_histogram,
    "similarity_density": q_similarity_density,
    "select_by_cumulative": q_select_by_cumulative,
    "explained_variance_cut": q_explained_variance_cut,
    "inertia_curve": q_inertia_curve,
    "silhouette": q_silhouette,
    "best_k_silhouette": q_best_k_silhouette,
    "best_k_elbow": q_best_k_elbow,
    "best_cluster_count": q_best_cluster_count,
    "stratified_split": q_stratified_split,
    "stratified_folds": q_stratified_folds,
    "accuracy_f1": q_accuracy_f1,
    "classification_report": q_classification_report,
    "confusion_matrix": q_confusion_matrix,
    "top_importances": q_top_importances,
    "correlation_triangle": q_correlation_triangle,
    "segment_map_table": q_segment_map_table,
    "confusion_table": q_confusion_table,
    "top_missing": q_top_missing,
    "profile_radar": q_profile_radar,
    "outlier_map_table": q_outlier_map_table,
}


# ---------------- operators checked by invariants (no exact SQL statement) ----------------


DEFAULT = AnalysisConfig()


def _std_vecs(spark, d, ef: DataFrame | None = None):
    """Standardized vectors; the orders are added up once for the means and for every later scan."""
    ef = cut_lineage(_ef(spark, d)) if ef is None else ef
    return ml.standardized_vectors(ef, ENTITY_FEATURES, keep=["entity_id", "region", "segment"])


def q_knn_impute(spark, d):
    wide = tables.entity_pivot(spark, d, "status")
    return _round(impute.knn_imputations(wide, feature_columns(wide)), value=MONEY)


def q_iterative_impute(spark, d):
    wide = tables.entity_pivot(spark, d, "priority")
    feats = feature_columns(wide)
    filled = impute.iterative_impute(wide, feats)
    return _round(unpivot_features(filled, ["entity_id"], feats), value=MONEY)


def q_isolation_forest(spark, d):
    return _round(outliers.isolation_forest(_ef(spark, d), ENTITY_FEATURES))


def q_kmeans_sweep(spark, d):
    sw = ml.kmeans_sweep(_std_vecs(spark, d))
    return _round(sw.curve(spark), 4)


def q_pseudo_labels(spark, d):
    return ml.pseudo_labels(_std_vecs(spark, d)).select("entity_id", "label")


def q_forest_importance(spark, d):
    lab = ml.pseudo_labels(_std_vecs(spark, d))
    return _round(ml.forest_importance(lab, ENTITY_FEATURES))


def q_pca_scores(spark, d):
    v = _std_vecs(spark, d)
    return _round(ml.pca_fit(v, ENTITY_FEATURES).scores(v))


def q_pca_loadings(spark, d):
    v = _std_vecs(spark, d)
    return _round(ml.pca_fit(v, ENTITY_FEATURES).loadings(spark))


def q_gmm_segments(spark, d):
    return ml.gmm_segments(_std_vecs(spark, d), 3)


def q_assign_segments(spark, d):
    ef = cut_lineage(_ef(spark, d))
    v = _std_vecs(spark, d, ef)
    sw = ml.kmeans_sweep(v, ks=(DEFAULT.first_k,))
    rows, prof = ml.assign_segments(ef, sw.models[DEFAULT.first_k], v, ENTITY_FEATURES)
    return _round(prof, mean=MONEY)


def _labelled(spark, d):
    v = _std_vecs(spark, d)
    lab = ml.pseudo_labels(v)
    return cut_lineage(evaluate.stratified_folds(lab, "label"))


def q_boosted_segment_classifier(spark, d):
    data = _labelled(spark, d)
    model = classify.boosted_segment_classifier().fit(data)
    scored = classify.class_probabilities(model.transform(data))
    return _round(scored.select("entity_id", F.col("label").cast("int").alias("label"),
                                F.col("prediction").cast("int").alias("prediction"),
                                F.get("probabilities", F.col("prediction").cast("int")).alias("probability")))


def q_grid_search(spark, d):
    res = classify.grid_search(_labelled(spark, d), classify.DEFAULT_GRID)
    return _round(spark.createDataFrame([(str(res.params), float(res.score))], "params string, f1_weighted double"))


def q_model_importance(spark, d):
    data = _labelled(spark, d)
    model = classify.boosted_segment_classifier().fit(data)
    return _round(classify.model_importance(model, ENTITY_FEATURES, spark))


def q_class_attributions(spark, d):
    data = _labelled(spark, d)
    model = classify.boosted_segment_classifier().fit(data)
    return _round(classify.class_attributions(model, data, ENTITY_FEATURES))


def _mixed(spark, d):
    st = tables.entity_pivot(spark, d, "status")
    pr = tables.entity_pivot(spark, d, "priority").drop("region", "segment")
    return st.join(pr, "entity_id")


def q_preprocess(spark, d):
    pre = pipeline.preprocess(_mixed(spark, d))
    return _round(unpivot_features(pre.table, ["entity_id"], pre.features), value=MONEY)


def q_run_segmentation(spark, d):
    res = pipeline.run_segmentation(_ef(spark, d).drop("name"), DEFAULT, grid=classify.DEFAULT_GRID)
    return res.summary.drop("runtime_seconds")


def q_build_report_tables(spark, d):
    ef = cut_lineage(_ef(spark, d))
    v = _std_vecs(spark, d, ef)
    k = DEFAULT.first_k
    sw = ml.kmeans_sweep(v, ks=(k,))
    rows, prof = ml.assign_segments(ef, sw.models[k], v, ENTITY_FEATURES)
    art = {f"assignments_{k}": rows.select("entity_id", "region", "segment"), f"segment_profiles_{k}": prof,
           "missing_profile": profile.missing_profile(ef, ENTITY_FEATURES),
           "correlation_matrix": cut_lineage(profile.correlation_matrix(ef, ENTITY_FEATURES)),
           "precise_lookalikes": cut_lineage(match.precise_lookalikes(ef, ENTITY_FEATURES))}
    imp = ml.forest_importance(ml.pseudo_labels(v), ENTITY_FEATURES)
    parts = []
    for name, frame in sorted(pipeline.build_report_tables(art, importances=imp).items()):
        numbers = [F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)) for f in frame.schema.fields
                   if isinstance(f.dataType, T.NumericType)]
        total = F.sum(sum(numbers, F.lit(0.0)))
        parts.append(frame.agg(F.count("*").alias("n_rows"), total.alias("total")).select(F.lit(name).alias("report_table"), "n_rows", "total"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _round(out, 2)


def q_run_summary(spark, d):
    ef = _ef(spark, d)
    n = ef.count()
    return writers.run_summary(spark, {"n_rows": n, "n_input_features": len(ENTITY_FEATURES)})


def q_save_model(spark, d):
    data = _labelled(spark, d)
    model = classify.boosted_segment_classifier().fit(data)
    path = _scratch(spark)
    writers.save_model(model, path, {"num_features": len(ENTITY_FEATURES)}, spark)
    # the model read back predicts what the model that was saved predicts
    again = BoostedModel.load(spark, f"{path}/model").transform(data).select("entity_id", F.col("prediction").alias("reloaded"))
    both = model.transform(data).select("entity_id", "prediction").join(again, "entity_id")
    return both.agg(F.count("*").alias("n_rows"), F.sum((F.col("prediction") == F.col("reloaded")).cast("long")).alias("n_equal"))


QUERIES.update({
    "knn_impute": q_knn_impute,
    "iterative_impute": q_iterative_impute,
    "isolation_forest": q_isolation_forest,
    "kmeans_sweep": q_kmeans_sweep,
    "pseudo_labels": q_pseudo_labels,
    "forest_importance": q_forest_importance,
    "pca_scores": q_pca_scores,
    "pca_loadings": q_pca_loadings,
    "gmm_segments": q_gmm_segments,
    "assign_segments": q_assign_segments,
    "boosted_segment_classifier": q_boosted_segment_classifier,
    "grid_search": q_grid_search,
    "model_importance": q_model_importance,
    "class_attributions": q_class_attributions,
    "preprocess": q_preprocess,
    "run_segmentation": q_run_segmentation,
    "build_report_tables": q_build_report_tables,
    "run_summary": q_run_summary,
    "save_model": q_save_model,
})


# ---------------- files: GeoJSON, GeoPackage, gzip text ----------------



def _points(spark, d):
    """Customers as points: x = account balance, y = nation key (a stand-in geometry)."""
    c = tables.customers(spark, d)
    geom = F.to_json(F.struct(F.lit("Point").alias("type"),
                              F.array(F.col("acctbal"), F.col("region").cast("double")).alias("coordinates")))
    return c.select("entity_id", "segment", geom.alias("geometry"))


def q_write_geojson_lines(spark, d):
    path = _scratch(spark)
    writers.write_geojson_lines(_points(spark, d), path)
    return spark.read.text(path)


def q_read_geojson(spark, d):
    path = _scratch(spark)
    writers.write_geojson_lines(_points(spark, d), path)
    feats = readers.read_geojson(spark, path)
    coords = F.from_json("geometry", "type string, coordinates array<double>")["coordinates"]
    out = feats.select(F.col("properties")["entity_id"].cast("long").alias("entity_id"),
                       F.col("properties")["segment"].alias("segment"),
                       coords[0].alias("x"), coords[1].alias("y"))
    return _round(out, x=MONEY)


def q_ingest_gzip_text(spark, d):
    path = _scratch(spark)
    docs = readers.read_table(spark, d, "documents").select("text")
    docs.write.option("compression", "gzip").text(path)
    lines, _ = readers.ingest_gzip_text(spark, f"{path}/*.gz", out=f"{path}_expanded",
                                        partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.select(F.trim("value").alias("value"))



QUERIES.update({
    "write_geojson_lines": q_write_geojson_lines,
    "read_geojson": q_read_geojson,
    "ingest_gzip_text": q_ingest_gzip_text,
})


# ---------------- graph-shaped operators ----------------



def _std_arrays(spark, d):
    return _std_vecs(spark, d).select("entity_id", vector_to_array(ml.VEC).alias("features"))


def q_density_segments(spark, d):
    return graph.density_segments(_std_arrays(spark, d), eps=0.6, min_samples=5)


def q_neighbor_graph_2d(spark, d):
    return _round(graph.neighbor_graph_2d(tables.vectors(spark, d), k=15), 4)


def q_silhouette_fast(spark, d):
    v = _std_vecs(spark, d)
    sw = ml.kmeans_sweep(v, ks=DEFAULT.sweep_ks)
    rows = []
    for k, m in sorted(sw.models.items()):
        rows.append((int(k), float(evaluate.fast_silhouette(m.transform(v), ml.VEC))))
    return _round(spark.createDataFrame(rows, "k int, silhouette double"))


QUERIES.update({
    "density_segments": q_density_segments,
    "neighbor_graph_2d": q_neighbor_graph_2d,
    "silhouette_fast": q_silhouette_fast,
})
