"""Invariants for operators without an exact SQL statement, on planted fixtures and brute force."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lookalike.config import AnalysisConfig
from lookalike.operators import clean, evaluate, graph, impute, match, ml, outliers, profile, similarity
from lookalike.operators.scale import fit_standardizer
from lookalike.operators.similarity import topk_similarity
from lookalike.sources import geopackage, readers, writers

SMALL = AnalysisConfig(isolation_trees=40, kmeans_starts=2, forest_trees=10, iterative_rounds=3)


def blobs(spark, n_per=60, seed=0, dims=6, regions=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 10, (3, dims))
    rows = []
    for c in range(3):
        pts = centers[c] + rng.normal(0, 0.5, (n_per, dims))
        for p in pts:
            i = len(rows)
            rows.append((i, int(i % regions), f"s{c}", [float(x) for x in p]))
    return spark.createDataFrame(rows, "entity_id long, region int, segment string, features array<double>")


def brute_topk(pdf, k, rule, per_region, min_sim):
    X = np.vstack(pdf["features"].to_numpy())
    U = X / np.where(np.linalg.norm(X, axis=1) > 0, np.linalg.norm(X, axis=1), 1)[:, None]
    S = U @ U.T
    out = []
    ids, reg, seg = pdf["entity_id"].to_numpy(), pdf["region"].to_numpy(), pdf["segment"].to_numpy()
    for i in range(len(ids)):
        cand = [(S[i, j], ids[j], reg[j]) for j in range(len(ids))
                if ids[j] != ids[i] and seg[j] == seg[i]
                and (rule != "lt" or reg[i] < reg[j]) and (rule != "ne" or reg[i] != reg[j])
                and (min_sim is None or S[i, j] >= min_sim)]
        groups = {}
        for s, j, r in cand:
            groups.setdefault(r if per_region else 0, []).append((-s, j))
        for g in groups.values():
            for s, j in sorted(g)[:k]:
                out.append((int(ids[i]), int(j), round(-s, 9)))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16, 4096])
@pytest.mark.parametrize("rule,per_region", [("lt", True), ("ne", False), ("any", False)])
def test_topk_matches_brute_force(spark, block_rows, rule, per_region):
    df = blobs(spark, n_per=25)
    got = similarity.topk_similarity(df, k=3, group_col="segment", region_rule=rule, per_region=per_region,
                                     min_sim=0.0, block_rows=block_rows).toPandas()
    got = sorted((int(a), int(b), round(s, 9)) for a, b, s in zip(got.a_id, got.b_id, got.similarity))
    assert got == brute_topk(df.toPandas(), 3, rule, per_region, 0.0)


def test_duplicates_are_not_self_matches(spark):
    df = blobs(spark, n_per=10)
    dup = df.withColumn("entity_id", F.col("entity_id") + 1000).withColumn("region", (F.col("region") + 1) % 4)
    both = df.unionByName(dup)
    out = match.nearest_lookalikes(both, "features", k=1).toPandas()
    assert (out.a_id != out.b_id).all()
    assert np.allclose(out.similarity, 1.0)  # every row finds its copy in another region


def test_single_region_segment_gives_empty_typed_result(spark):
    rows = [(i, 1, "only", float(i), float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "entity_id long, region int, segment string, x double, y double")
    out = match.precise_lookalikes(df, ["x", "y"])
    assert out.count() == 0 and out.columns[-1] == "similarity"
    assert match.sampled_lookalikes(df).count() == 0


def test_order_independence(spark):
    df = blobs(spark, n_per=20)
    a = match.nearest_lookalikes(df, "features", k=4).toPandas()
    b = match.nearest_lookalikes(df.repartition(7).orderBy(F.rand(3)), "features", k=4).toPandas()
    key = ["a_id", "b_id"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_knn_impute_keeps_observed_cells_and_fills_all(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(80, 4))
    mask = rng.random(X.shape) < 0.08
    rows = [(i, *[None if mask[i, j] else float(X[i, j]) for j in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double, d double")
    out = impute.knn_impute(df, ["a", "b", "c", "d"], k=5).toPandas().sort_values("entity_id")
    assert not out[["a", "b", "c", "d"]].isna().any().any()
    obs = ~mask
    assert np.allclose(out[["a", "b", "c", "d"]].to_numpy()[obs], X[obs])


def test_knn_impute_brute_force(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))
    X[rng.random(X.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double")
    got = {(r.entity_id, r.feature): r.value for r in impute.knn_imputations(df, ["a", "b", "c"], k=5,
                                                                              block_rows=8).collect()}
    for i in range(40):
        for j in range(3):
            if not np.isnan(X[i, j]):
                continue
            cands = []
            for m in range(40):
                if np.isnan(X[m, j]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[m])
                if not both.any():
                    continue
                d = np.sqrt(3 / both.sum() * ((X[i, both] - X[m, both]) ** 2).sum())
                cands.append((d, m))
            top = sorted(cands)[:5]
            w = np.array([1 / d for d, _ in top])
            v = np.array([X[m, j] for _, m in top])
            assert got[(i, "abc"[j])] == pytest.approx((w * v).sum() / w.sum(), rel=1e-9)


def test_iterative_impute_fills_and_keeps(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(100, 1))
    X = np.hstack([base, 2 * base + rng.normal(0, 0.01, (100, 1)), rng.normal(size=(100, 1))])
    mask = rng.random(X.shape) < 0.2
    rows = [(i, *[None if mask[i, j] else float(X[i, j]) for j in range(3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double")
    out = impute.iterative_impute(df, ["a", "b", "c"], SMALL).toPandas().sort_values("entity_id")
    vals = out[["a", "b", "c"]].to_numpy()
    assert not np.isnan(vals).any()
    assert np.allclose(vals[~mask], X[~mask])
    both = mask[:, 1] & ~mask[:, 0]   # b missing, a observed: the regression recovers b ≈ 2a
    assert np.abs(vals[both, 1] - 2 * X[both, 0]).max() < 0.2


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(400, 3))
    X[:8] += 12.0
    rows = [(i, *map(float, X[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double")
    out = outliers.isolation_forest(df, ["a", "b", "c"], SMALL).toPandas()
    share = out.is_outlier.mean()
    assert 0.03 <= share <= 0.07
    worst = set(out.sort_values("outlier_score").entity_id.head(8))
    assert worst == set(range(8))


def test_kmeans_pca_forest_invariants(spark):
    df = blobs(spark, n_per=40).select("entity_id", *[F.col("features")[i].alias(f"f{i}") for i in range(6)])
    feats = [f"f{i}" for i in range(6)]
    vecs = ml.standardized_vectors(df, feats).cache()
    sw = ml.kmeans_sweep(vecs, ks=[2, 3, 4], starts=2, cfg=SMALL)
    assert sw.costs[2] > sw.costs[3] > sw.costs[4]
    imp = ml.forest_importance(ml.pseudo_labels(vecs, 3, SMALL), feats, SMALL).toPandas()
    assert imp.importance.sum() == pytest.approx(1.0)
    p = ml.pca_fit(vecs, feats)
    r = p.ratios(spark).toPandas().ratio.to_numpy()
    assert (np.diff(r) <= 1e-12).all() and r.sum() <= 1 + 1e-9
    pc = p.model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(pc.shape[1]), atol=1e-8)


def test_density_segments_recovers_blobs(spark):
    df = blobs(spark, n_per=50, dims=2)
    seg = graph.density_segments(df, eps=1.5, min_samples=4, block_rows=32).toPandas()
    truth = df.select("entity_id", "segment").toPandas().merge(seg, on="entity_id", suffixes=("_t", ""))
    assert truth.groupby("segment_t").segment.nunique().max() == 1
    assert truth.segment.nunique() == 3


def test_exact_silhouette_brute_force(spark):
    df = blobs(spark, n_per=12, dims=3)
    labels = df.select(F.lit(3).alias("k"), "entity_id",
                       F.pmod(F.col("entity_id"), F.lit(3)).cast("int").alias("segment"))
    got = evaluate.silhouette(df, labels, block_rows=8).first()["silhouette"]
    pdf = df.toPandas()
    X = np.vstack(pdf.features.to_numpy())
    lab = pdf.entity_id.to_numpy() % 3
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-9)


def test_exact_rank_matches_window(spark):
    rows = [(i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "entity_id long, label int")
    got = evaluate.exact_rank(df, ["label"]).toPandas()
    pdf = pd.DataFrame(rows, columns=["entity_id", "label"])
    pdf["key"] = (pdf.entity_id * 7919) % 10007
    pdf["want"] = pdf.sort_values(["key", "entity_id"]).groupby("label").cumcount() + 1
    m = got.merge(pdf, on=["entity_id", "label"])
    assert (m["rank"] == m["want"]).all()


def test_profiles_on_constant_and_collinear(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 4))
    cols = {f"b{i}": base[:, i] for i in range(4)}
    for i in range(7):
        cols[f"c{i}"] = base[:, i % 4] * (i + 2) + rng.normal(0, 1e-4, 50)
    cols["const"] = np.ones(50)
    pdf = pd.DataFrame(cols)
    pdf.insert(0, "entity_id", np.arange(50))
    df = spark.createDataFrame(pdf)
    feats = [c for c in pdf.columns if c != "entity_id"]
    corr = profile.correlation_matrix(df, feats)
    const_r = corr.filter((F.col("feature_a") == "const") & (F.col("feature_b") != "const")).toPandas()
    assert const_r.r.isna().all()                      # no division-by-zero error, NULL instead
    extreme = profile.extreme_correlations(corr)
    assert extreme.count() > 5
    dropped = {r.feature for r in profile.prune_correlated(df, extreme, feats).collect()}
    assert dropped and dropped <= set(feats)
    low = {r.feature for r in clean.low_variance_features(df, feats).collect()}
    assert "const" in low
    z = fit_standardizer(df, ["const", "b0"]).transform(df).select("const").distinct().collect()
    assert [r.const for r in z] == [0.0]


def test_geo_and_text_round_trips(spark, tmp_path):
    pdf = pd.DataFrame({"entity_id": [1, 2, 3], "segment": ["a", "b", None], "x": [0.5, 1.5, 2.5],
                        "y": [1.0, 2.0, 3.0]})
    folder = tmp_path / "gpkg"
    folder.mkdir()
    (folder / "one.gpkg").write_bytes(geopackage.build_gpkg(pdf))
    (folder / "two.gpkg").write_bytes(geopackage.build_gpkg(pdf.assign(entity_id=[4, 5, 6])))
    feats = geopackage.read_gpkg_files(spark, str(folder)).toPandas()
    assert sorted(int(p["entity_id"]) for p in feats.properties) == [1, 2, 3, 4, 5, 6]
    assert all(len(g) == 21 for g in feats.geometry)   # one little-endian WKB point
    gz = tmp_path / "counts.txt.gz"
    import gzip
    with gzip.open(gz, "wt") as fh:
        fh.write("  a  \nb\n c\n")
    lines, out = readers.ingest_gzip_text(spark, str(gz))
    assert out.endswith("counts.txt.parquet")
    assert [r.value for r in readers.preview_lines(lines).collect()] == ["a", "b", "c"]
    geo = spark.createDataFrame([(1, "s", '{"type":"Point","coordinates":[1.0,2.0]}')],
                                "entity_id long, segment string, geometry string")
    path = str(tmp_path / "geo")
    writers.write_geojson_lines(geo, path)
    back = readers.read_geojson(spark, path).first()
    assert back.properties["segment"] == "s" and '"coordinates":[1.0,2.0]' in back.geometry.replace(" ", "")


def test_read_entities_typed_errors(spark, tmp_path):
    with pytest.raises(readers.MissingSourceError):
        readers.read_entities(spark, str(tmp_path / "nope.parquet"))
    p = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "entity_id long, x double").write.parquet(p)
    with pytest.raises(readers.EmptySourceError):
        readers.read_entities(spark, p)
    q = str(tmp_path / "nan.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "entity_id long, x double").write.parquet(q)
    got = readers.read_entities(spark, q).orderBy("entity_id").collect()
    assert got[0].x is None and got[1].x == 1.0


def test_empty_feature_lists_give_typed_empty_results(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "entity_id long, x double")
    assert profile.quality_report(df, []).count() == 0
    assert profile.missing_profile(df, []).columns == ["feature", "missing_count", "missing_percent"]
    assert clean.iqr_bounds(df, []).count() == 0
    assert profile.correlation_matrix(df, []).count() == 0
    assert clean.median_fill(df, []).count() == 2
    assert fit_standardizer(df, []).transform(df).columns == ["entity_id", "x"]


def test_neighbor_graph_layout_separates_blobs(spark):
    df = blobs(spark, n_per=30, dims=4)
    lay = graph.neighbor_graph_2d(df, k=8).toPandas()
    seg = df.select("entity_id", "segment").toPandas().merge(lay, on="entity_id")
    cents = seg.groupby("segment")[["umap1", "umap2"]].mean()
    within = np.mean([np.hypot(r.umap1 - cents.loc[r.segment, "umap1"], r.umap2 - cents.loc[r.segment, "umap2"])
                      for r in seg.itertuples()])
    between = np.mean([np.hypot(*(cents.iloc[a] - cents.iloc[b])) for a in range(3) for b in range(a + 1, 3)])
    assert len(lay) == 90 and within < between / 3
    assert np.abs(lay[["umap1", "umap2"]].to_numpy()).max() == pytest.approx(10.0)


@pytest.mark.parametrize("last_values", [0, 500, 1_000_000])
def test_narrowed_quantiles_match_numpy(spark, last_values):
    from lookalike.functions.quantiles import quantiles
    rng = np.random.default_rng(6)
    n = 6000
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.34, 0.0, rng.exponential(size=n))   # one value holds a third
    c = rng.choice([-1e300, -2.5, -0.0, 5e-324, 2.0 ** -1022, 1.0, 1.0 + 2 ** -52, 2.0, 1e300], n)
    rows = [(i, float(a[i]), None if i % 9 == 0 else float(b[i]), float(c[i]), None, 7.0 if i == 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double, d double, e double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles(df, ["a", "b", "c", "d", "e"], probs, last_values=last_values)
    bb = np.array([b[i] for i in range(n) if i % 9 != 0])
    for values, found in ((a, got["a"]), (bb, got["b"]), (c, got["c"])):
        want = np.quantile(values, probs)
        assert np.allclose(found, want, rtol=1e-12, atol=1e-12) and found[0] == values.min() and found[-1] == values.max()
    assert got["d"] is None and got["e"] == [7.0] * 7
    assert quantiles(df.limit(0), ["a"], [0.5]) == {"a": None}


def test_ordered_bits_equal_the_bits(spark):
    from lookalike.functions.quantiles import ordered_bits
    rng = np.random.default_rng(2)
    v = np.concatenate([2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1021, 1024), 0), np.nextafter(2.0 ** np.arange(-1021, 1023), np.inf),
                        rng.integers(0, 1 << 52, 500) * 5e-324, rng.normal(size=500), [0.0, np.inf]])
    v = np.concatenate([v, -v])
    want = np.abs(v).view(np.int64) * np.where(v < 0, -1, 1)
    got = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").select(
        "i", ordered_bits(F.col("v")).alias("k")).orderBy("i").toPandas()["k"].to_numpy()
    assert (got == want).all()


def test_histogram_and_density_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.4, 0.2, 700)
    df = spark.createDataFrame([(float(v),) for v in x], "similarity double")
    hist = match.similarity_histogram(df, bins=20).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=20)
    assert hist.n.tolist() == counts.tolist()
    assert np.allclose(hist.lower, edges[:-1]) and np.allclose(hist.upper, edges[1:])
    dens = match.similarity_density(df, grid=50).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** (-1 / 5)
    want = np.exp(-((dens.x.to_numpy()[:, None] - x[None, :]) / h) ** 2 / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(dens.density, want, rtol=1e-9)
    assert np.trapezoid(dens.density, dens.x) == pytest.approx(1.0, abs=0.01)


def test_confusion_matrix_zero_fills_union_of_classes(spark):
    pred = spark.createDataFrame([(0, 0), (0, 2), (1, 0), (1, 1)], "label int, prediction int")
    long = evaluate.confusion_matrix(pred).toPandas()
    assert len(long) == 9 and long.n.sum() == 4                     # class 2 never a label, still a row
    wide = evaluate.confusion_matrix(pred, wide=True).toPandas()
    assert wide.shape == (3, 4) and wide.loc[wide.label == 2].iloc[0, 1:].tolist() == [0, 0, 0]


def _frame(spark, n=300, seed=8):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"entity_id": np.arange(n), "a": rng.gamma(2.0, 3.0, n), "b": rng.normal(5, 2, n)})
    pdf.loc[pdf.index % 11 == 0, "b"] = np.nan
    rows = [(int(r.entity_id), float(r.a), None if np.isnan(r.b) else float(r.b)) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows, "entity_id long, a double, b double")


def test_quality_and_describe_match_pandas(spark):
    pdf, df = _frame(spark)
    q = profile.quality_report(df, ["a", "b"]).toPandas().set_index("feature")
    for f in ["a", "b"]:
        s = pdf[f]
        assert q.loc[f, "mean"] == pytest.approx(s.mean())
        assert q.loc[f, "median"] == pytest.approx(s.median())
        assert q.loc[f, "std"] == pytest.approx(s.std())
        assert q.loc[f, "skewness"] == pytest.approx(s.skew())
        assert q.loc[f, "kurtosis"] == pytest.approx(s.kurt())
    d = profile.describe_features(df, ["a", "b"]).toPandas().set_index("feature")
    want = pdf[["a", "b"]].describe().T
    for f in ["a", "b"]:
        for col, pcol in (("count", "count"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert d.loc[f, col] == pytest.approx(want.loc[f, pcol])
    assert d.loc["b", "missing"] == pdf.b.isna().sum()


def test_robust_rescale_matches_numpy(spark):
    pdf, df = _frame(spark)
    scores = df.select("entity_id", (-(F.col("entity_id") % 5) / 4.0).alias("score"))   # rows with id%5 >= 3 are extreme
    out = clean.robust_rescale_extremes(df, scores, ["a"], threshold=-0.5).toPandas().sort_values("entity_id")
    ext = (pdf.entity_id % 5) >= 3
    q1, med, q3 = np.quantile(pdf.a[ext], [0.25, 0.5, 0.75])
    want = np.where(ext, (pdf.a - med) / (q3 - q1), pdf.a)
    assert np.allclose(out.a.to_numpy(), want)


def test_stratified_split_exact_class_counts(spark):
    rows = [(i, i % 3 if i % 10 else 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "entity_id long, label int")
    got = evaluate.stratified_split(df).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).toPandas()
    assert all(r.t == (r.n * 3) // 10 for r in got.itertuples())
    folds = evaluate.stratified_folds(df).groupBy("label", "fold").count().toPandas()
    assert (folds.groupby("label")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()


def test_weighted_precise_lookalikes_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 120
    X = rng.normal(size=(n, 3))
    reg, seg = rng.integers(0, 4, n), rng.integers(0, 2, n)
    rows = [(i, int(reg[i]), f"s{seg[i]}", *map(float, X[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id long, region int, segment string, x double, y double, z double")
    w = {"x": 2.0, "z": 0.5}
    got = match.precise_lookalikes(df, ["x", "y", "z"], k=3, weights=w, block_rows=16).toPandas()
    Z = (X - X.mean(0)) / X.std(0) * np.array([2.0, 1.0, 0.5])
    U = Z / np.linalg.norm(Z, axis=1)[:, None]
    S = U @ U.T
    want = []
    for i in range(n):
        for r in set(reg[(reg > reg[i]) & (seg == seg[i])]):
            cand = [(-S[i, j], j) for j in range(n) if reg[j] == r and seg[j] == seg[i] and S[i, j] >= 0]
            want += [(i, j) for _, j in sorted(cand)[:3]]
    assert sorted(zip(got.a_id, got.b_id)) == sorted(want)


def test_run_segmentation_options(spark):
    from conftest import SF001
    from lookalike.plans import pipeline
    from lookalike.sources import tables
    cfg = AnalysisConfig(sweep_ks=(2, 3), candidate_ks=(3,), first_k=3, kmeans_starts=1, forest_trees=10,
                         isolation_trees=20, folds=3, pseudo_label_k=3)
    ef = tables.entity_features(spark, SF001).drop("name")
    res = pipeline.run_segmentation(ef, cfg, k_policy="silhouette", features_from="pca", methods=("precise",))
    row = res.summary.first()
    assert row.errors == "" and row.n_rows == ef.count() and row.n_segments in (2, 3)
    assert "precise_lookalikes" in res.artefacts and "sampled_lookalikes" not in res.artefacts
    assert "cv_scores" not in res.artefacts          # the F1 search is skipped under the silhouette policy
    with pytest.raises(ValueError):
        pipeline.run_segmentation(ef, cfg, k_policy="nope")


def test_grouped_arrow_stage_is_spread_over_tasks(spark):
    """A window already partitions the rows by the group key; the grouped stage must still run on
    the session's shuffle-partition count (not be coalesced into one task by AQE)."""
    from pyspark.sql import Window

    from lookalike.session import apply_in_groups
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("v"))
    windowed = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v"))).filter("rn <= 50")
    out = apply_in_groups(windowed, ["g"], lambda key, pdf: pd.DataFrame({"g": [key[0]], "n": [len(pdf)]}),
                          "g long, n long")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.rdd.getNumPartitions() == n_parts
    assert sorted(r.n for r in out.collect()) == [50] * 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


# ---------------- ids, NULLs, caps and rounding (second round) ----------------

def test_long_chain_is_one_segment(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(400)], "entity_id long, features array<double>")
    seg = graph.density_segments(df, eps=1.1, min_samples=2, block_rows=40).toPandas()
    assert set(seg.segment) == {0} and seg.is_core.all()


def test_string_ids_keep_their_form(spark):
    rows = [(f"0{i}A", "r1" if i % 2 else None, "s", [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "entity_id string, region string, segment string, features array<double>")
    got = match.nearest_lookalikes(df, "features", k=3, mode="pre", min_sim=-1.0, block_rows=4)
    assert got.count() == 0  # a NULL region differs from nothing
    some = df.withColumn("region", F.coalesce("region", F.lit("r2")))
    pairs = match.nearest_lookalikes(some, "features", k=3, mode="pre", min_sim=-1.0, block_rows=4).toPandas()
    assert set(pairs.a_id) == {r[0] for r in rows}
    seg = graph.density_segments(df, eps=1.5, min_samples=2, block_rows=5).toPandas()
    assert set(seg.segment) == {"00A"}


def test_hash_rule_takes_large_and_text_ids(spark):
    big = [(2 ** 62 + i, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(big, "entity_id long, label double")
    split = evaluate.stratified_split(df).toPandas()
    assert split.groupby("label").is_test.sum().tolist() == [3, 3]
    text = df.select(F.concat(F.lit("0"), "entity_id").alias("entity_id"), F.when(F.col("label") == 1, 1.0).alias("label"))
    folds = evaluate.stratified_folds(text).toPandas()
    assert len(folds) == 20 and folds[folds.label.isna()].groupby("fold").size().tolist() == [2] * 5


def test_incomplete_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, [1.0, None]), (2, 1, [1.0, 2.0])], "entity_id long, region int, features array<double>")
    with pytest.raises(Exception, match="missing coordinate"):
        topk_similarity(df, k=1).collect()


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "entity_id long, a double, b double")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): None, ("a", "b"): None, ("b", "a"): None}


def test_geojson_is_valid_json(spark, tmp_path):
    from lookalike.sources.writers import geojson_features
    df = spark.createDataFrame([(1, "__GEOM__", '{"type":"Point","coordinates":[1.5,2]}'), (2, "x", None)],
                               "entity_id long, note string, geometry string")
    got = [json.loads(r["value"]) for r in geojson_features(df).orderBy("value").collect()]
    assert got[0] == {"type": "Feature", "properties": {"entity_id": 1, "note": "__GEOM__"},
                      "geometry": {"type": "Point", "coordinates": [1.5, 2]}}
    assert got[1]["geometry"] is None
    with pytest.raises(TypeError):
        geojson_features(df.withColumn("geometry", F.col("geometry").cast("binary")))


def test_output_rounding_is_half_up(spark):
    from lookalike.plans.catalog import _round
    df = spark.createDataFrame([(1.0040,), (2.3341,), (0.125,), (1.005,), (0.1 + 0.2,)], "v double")
    assert [r["v"] for r in _round(df, 2).collect()] == [1.0, 2.33, 0.13, 1.01, 0.3]


# ---------------- ids of any type ----------------

def test_string_ids_in_silhouette_and_donor_search(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (30, 2))])
    names = [f"0{i}g" if i % 2 else f"00{i}" for i in range(60)]
    seg = [0] * 30 + [1] * 30
    for ids in (names, list(range(60))):
        kind = "string" if ids is names else "long"
        vecs = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x)], f"entity_id {kind}, features array<double>")
        labels = spark.createDataFrame([(2, i, s) for i, s in zip(ids, seg)], f"k int, entity_id {kind}, segment int")
        got = evaluate.silhouette(vecs, labels, block_rows=16).first()["silhouette"]
        if kind == "string":
            first = got
        assert got == pytest.approx(first)
    rows = [(n, None if i % 7 == 0 else float(a), float(b) if i % 11 else None, None) for i, (n, (a, b)) in enumerate(zip(names, x))]
    df = spark.createDataFrame(rows, "entity_id string, a double, b double, c double")
    same = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "entity_id long, a double, b double, c double")
    named = {r.entity_id: (r.a, r.b, r.c) for r in impute.knn_impute(df, ["a", "b", "c"], k=3).collect()}
    numbered = {names[r.entity_id]: (r.a, r.b, r.c) for r in impute.knn_impute(same, ["a", "b", "c"], k=3).collect()}
    assert named == numbered and all(v[0] is not None and v[1] is not None for v in named.values())


def test_a_run_keeps_ids_with_zeros_and_letters(spark):
    from conftest import SF001
    from lookalike.plans import pipeline
    from lookalike.sources import tables
    cfg = AnalysisConfig(sweep_ks=(2, 3), candidate_ks=(3,), first_k=3, kmeans_starts=1, forest_trees=10,
                         isolation_trees=20, folds=3, pseudo_label_k=3)
    ef = tables.entity_features(spark, SF001).drop("name")
    named = ef.withColumn("entity_id", F.concat(F.lit("0"), F.col("entity_id").cast("string"), F.lit("g")))
    grid = {"learning_rate": [0.2], "max_depth": [2, 3], "n_estimators": [5, 10], "subsample": [0.8]}
    res = pipeline.run_segmentation(named, cfg, grid=grid, methods=("precise",))
    row = res.summary.first()
    assert row.errors == "" and row.n_rows == ef.count()
    ids = {r.entity_id for r in res.artefacts["assignments_3"].collect()}
    assert all(i.startswith("0") and i.endswith("g") for i in ids) and len(ids) == ef.count()
    assert res.artefacts["class_attributions"].count() == 3 * row.n_selected_features
    assert abs(sum(r.importance for r in res.artefacts["model_importance"].collect()) - 1) < 1e-9


def test_region_blocks_form_later_pairs_alone(spark):
    rng = np.random.default_rng(12)
    rows = [(i, f"r{i % 9}" if i % 13 else None, i % 2, rng.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "entity_id long, region string, grp int, features array<double>")
    tasks, several = similarity.region_pair_tasks(df, 50, later_only=True)
    pairs = {(r.grp, r.ablk, r.bblk) for r in tasks.where("is_left").select("grp", "ablk", "bblk").distinct().collect()}
    assert not several and all(a <= b for _, a, b in pairs) and any(a < b for _, a, b in pairs)
    _, several = similarity.region_pair_tasks(df, 10, later_only=True)
    assert several
    want = None
    for block_rows in (7, 50, 4096):
        got = topk_similarity(df, k=3, group_col="grp", region_rule="lt", per_region=True, min_sim=-1.0, block_rows=block_rows).toPandas()
        keys = sorted(zip(got.a_id, got.b_id))
        want = want or keys
        assert keys == want and len(set(keys)) == len(keys) and (got.a_region < got.b_region).all()


@pytest.mark.parametrize("metric,rule,floor", [("cosine", "any", None), ("cosine", "ne", 0.2), ("euclidean", "any", None)])
def test_bounded_search_skips_pairs_and_loses_no_row(spark, metric, rule, floor):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 6)) * 6
    x = np.vstack([m + rng.normal(0, 0.3, (50, 6)) for m in middles] + [np.zeros((2, 6))])
    rows = [(f"0{i}", f"r{i % 5}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity_id string, region string, features array<double>")
    options = {"k": 4, "region_rule": rule, "min_sim": floor, "metric": metric}
    plain = topk_similarity(df, block_rows=600, **options).toPandas()
    stats = {}
    got = topk_similarity(df, block_rows=40, stats=stats, **options).toPandas()
    key = ["a_id", "b_id"]
    a, b = (t.sort_values(key).reset_index(drop=True) for t in (plain, got))
    assert len(a) == len(b) and np.allclose(sorted(a.similarity), sorted(b.similarity), atol=1e-9)
    same = set(map(tuple, a[key].to_numpy())) ^ set(map(tuple, b[key].to_numpy()))
    assert len(same) <= 8          # ties at the k-th place that differ by rounding (the two zero vectors)
    assert stats["scored"] < 0.7 * stats["block_pairs"], stats


def test_silhouette_of_partial_labels(spark):
    """Each k is scored over the rows that it labels, whatever the blocks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, features array<double>")
    rows = [(2, i, i % 2) for i in range(40)] + [(3, i, i % 3) for i in range(30)]
    labels = spark.createDataFrame(rows, "k int, entity_id long, segment int")

    def plain(n, k):
        d = np.sqrt(((x[:n, None] - x[None, :n]) ** 2).sum(2))
        lab, out = np.arange(n) % k, []
        for i in range(n):
            own = d[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
            other = min(d[i][lab == c].mean() for c in range(k) if c != lab[i])
            out.append((other - own) / max(own, other))
        return float(np.mean(out))
    for block_rows in (3, 4096):
        got = {r.k: r.silhouette for r in evaluate.silhouette(vecs, labels, block_rows=block_rows).collect()}
        assert got == pytest.approx({2: plain(40, 2), 3: plain(30, 3)})


def test_many_groups_are_not_read_back(spark):
    from lookalike.operators import scale
    df = spark.createDataFrame([(i, i % 1100, float(i % 17)) for i in range(2200)], "entity_id long, segment int, x double")
    model, sizes = scale.fit_standardizer_by_group(df, ["x"], "segment")
    few, counted = scale.fit_standardizer_by_group(df.withColumn("segment", F.col("segment") % 7), ["x"], "segment")
    assert sizes is None and sum(counted.values()) == 2200
    assert model.means == pytest.approx(few.means) and model.stds == pytest.approx(few.stds)
