"""Evaluation and selection on small curves and label tables:
M3 select_by_cumulative, M6 explained_variance_cut, M9 inertia_curve, M10 silhouette,
M11 best_k_silhouette, M12 best_k_elbow, M16 stratified_split, M17 stratified_folds,
M20 best_cluster_count, M21 accuracy_f1, M22 classification_report, M23 confusion_matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.config import DEFAULT, AnalysisConfig
from lookalike.operators.similarity import DEFAULT_BLOCK_ROWS, block_pair_tasks, euclidean
from lookalike.session import apply_in_groups

ORACLE_KEY_MAX = 10007


def oracle_hash_key(id_type: T.DataType, id_col: str = "entity_id") -> F.Column:
    """Integer shuffle rule both Spark and the SQL oracle can evaluate: (id * 7919) % 10007.  The
    id is reduced first, so that large ids don't overflow; ids that are not integers are hashed."""
    number = F.col(id_col) if isinstance(id_type, T.IntegralType) else F.xxhash64(id_col)
    return F.pmod(F.pmod(number.cast("long"), F.lit(ORACLE_KEY_MAX)) * F.lit(7919), F.lit(ORACLE_KEY_MAX))


#: Key ranges that each partition of ``exact_rank`` is cut into, whatever its size.
RANK_CELLS = 512


def exact_rank(df: DataFrame, by: list[str], key: F.Column | None = None, key_max: int = ORACLE_KEY_MAX,
               tiebreak: str = "entity_id") -> DataFrame:
    """row_number() over (partition by ``by`` order by key, tiebreak) without ever sending a
    whole partition to one task.

    Each partition is cut into RANK_CELLS key ranges; rows are dealt and ranked by (partition,
    range) cell, and the cells' offsets and the partitions' totals come from running sums over the
    small table of cell counts.  Adds columns ``rank`` (1-based) and ``n_in_group``.
    ``key`` must be an integer in [0, key_max); default: the oracle hash rule.
    """
    key = oracle_hash_key(df.schema[tiebreak].dataType, tiebreak) if key is None else key
    cells = df.withColumn("_key", key.cast("long")).withColumn(
        "_cell", F.floor(F.col("_key") * F.lit(RANK_CELLS) / F.lit(key_max)).cast("int"))
    counts = cells.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_cell").alias("_at"),
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n_in_group"))
    local = cells.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_key", tiebreak)))
    same = local["_cell"] == offsets["_at"]
    for c in by:
        same = same & local[c].eqNullSafe(offsets[f"_by_{c}"])
    return (local.join(offsets, same).withColumn("rank", F.col("_off") + F.col("_local"))
            .select(*df.columns, "rank", "n_in_group"))


def stratified_split(df: DataFrame, label: str = "label", cfg: AnalysisConfig = DEFAULT,
                     key: F.Column | None = None, key_max: int = ORACLE_KEY_MAX) -> DataFrame:
    """Per label, the first floor(n * test_share) rows in hash order are the test rows.
    Exact per-class counts (``sampleBy`` is only approximate)."""
    permille = int(round(cfg.test_share * 1000))
    ranked = exact_rank(df, [label], key, key_max)
    return ranked.withColumn("is_test", F.col("rank") * 1000 <= F.col("n_in_group") * permille).drop(
        "rank", "n_in_group")


def stratified_folds(df: DataFrame, label: str = "label", cfg: AnalysisConfig = DEFAULT,
                     key: F.Column | None = None, key_max: int = ORACLE_KEY_MAX) -> DataFrame:
    """fold = (rank - 1) mod folds inside each label → balanced, stratified folds."""
    ranked = exact_rank(df, [label], key, key_max)
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(cfg.folds)).cast("int")).drop(
        "rank", "n_in_group")


# ---------- classification metrics over (label, prediction) ----------

def _per_class(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, tp, n_true, n_pred) over the union of labels and predictions: one aggregate."""
    both = pred.select(F.col(label).alias("t"), F.col(prediction).alias("p"))
    ev = both.select(F.explode(F.array(
        F.struct(F.col("t").alias("cls"), (F.col("t") == F.col("p")).cast("int").alias("tp"),
                 F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")),
        F.struct(F.col("p").alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("is_true"),
                 F.lit(1).alias("is_pred")))).alias("e")).select("e.*")
    return ev.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("is_true").alias("support"),
                                 F.sum("is_pred").alias("n_pred"))


def _prf(per: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    return per.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
        .otherwise(F.lit(0.0)))


def accuracy_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1 (one row)."""
    per = _prf(_per_class(pred, label, prediction))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                   (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision/recall/f1/support, then accuracy, macro avg and weighted avg rows
    (undefined ratios are 0)."""
    per = _prf(_per_class(pred, label, prediction))
    classes = per.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                         F.col("support").cast("long").alias("support"))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))))
    return classes.unionByName(summary)


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     offset: int = 0, wide: bool = False) -> DataFrame:
    """Dense (label, prediction, n) over the union of classes, zero-filled.

    The class list is bounded by the number of segments; it is turned into the dense grid with
    two ``explode`` generators and the counts are left-joined onto it.
    """
    counts = pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    classes = pred.select(F.col(label).alias("c")).union(pred.select(F.col(prediction).alias("c"))).distinct()
    grid_src = classes.agg(F.sort_array(F.collect_set("c")).alias("cs"))
    grid = grid_src.select(F.explode("cs").alias("label"), "cs").select(
        "label", F.explode("cs").alias("prediction"))
    out = grid.join(counts, ["label", "prediction"], "left").select(
        (F.col("label") + offset).alias("label"), (F.col("prediction") + offset).alias("prediction"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if wide:
        # export form: one row per true class, one column per predicted class (classes are few)
        return out.groupBy("label").pivot("prediction").agg(F.first("n")).orderBy("label")
    return out


# ---------- curves ----------

def select_by_cumulative(importances: DataFrame, share: float | None = None, cfg: AnalysisConfig = DEFAULT,
                         value: str = "importance") -> DataFrame:
    """M3: smallest prefix (by importance desc, then name) whose cumulative sum reaches ``share``;
    the crossing row is included.  Runs on the per-feature frame (one row per feature)."""
    share = cfg.importance_share if share is None else share
    w = Window.orderBy(F.col(value).desc(), F.col("feature")).rowsBetween(Window.unboundedPreceding, 0)
    cum = importances.withColumn("cumulative", F.sum(value).over(w))
    return cum.filter(F.col("cumulative") - F.col(value) < F.lit(share))


def explained_variance_cut(ratios: DataFrame, share: float | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """M6: the fewest leading components whose cumulative ratio reaches ``share``
    (input: component int, ratio double)."""
    share = cfg.variance_share if share is None else share
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    cum = ratios.withColumn("cumulative", F.sum("ratio").over(w))
    return cum.filter(F.col("cumulative") - F.col("ratio") < F.lit(share))


def inertia_curve(vecs: DataFrame, labels: DataFrame, features: str = "features") -> DataFrame:
    """M9: (k, inertia) = sum of squared distances to the cluster mean, for given labels
    (labels: k, entity_id, segment).

    One grouped pass per (k, segment): row count, sum of |x|² and the mean vector (MLlib
    ``Summarizer``, a real vector aggregate with partial merging); SSE = Σ|x|² - n |mean|².
    Rows stay whole vectors, so the shuffle carries (k × n) rows, not (k × n × d)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vecs.select("entity_id", array_to_vector(features).alias("_v"),
                       F.aggregate(features, F.lit(0.0), lambda acc, x: acc + x * x).alias("_ss"))
    per = labels.join(rows, "entity_id").groupBy("k", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_ss").alias("ss"), Summarizer.mean(F.col("_v")).alias("m"))
    mean_sq = F.aggregate(vector_to_array("m"), F.lit(0.0), lambda acc, x: acc + x * x)
    return per.groupBy("k").agg(F.sum(F.col("ss") - F.col("n") * mean_sq).alias("inertia"))


def best_k_silhouette(curve: DataFrame, score: str = "silhouette") -> DataFrame:
    """Argmax of the score, the lowest k on ties."""
    return curve.orderBy(F.col(score).desc(), F.col("k")).limit(1).select("k", score)


def best_k_elbow(curve: DataFrame, value: str = "inertia") -> DataFrame:
    """The k at the largest second difference prev - 2 cur + next (first on ties)."""
    w = Window.orderBy("k")
    d2 = curve.withColumn("d2", F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w))
    return d2.filter(F.col("d2").isNotNull()).orderBy(F.col("d2").desc(), "k").limit(1).select("k", "d2")


def best_cluster_count(scores: DataFrame, score: str = "score") -> DataFrame:
    """The k with the best cross-validated score, the lowest k on ties."""
    return scores.orderBy(F.col(score).desc(), F.col("k")).limit(1).select("k", score)


# ---------- exact silhouette (blocked, never one pair per row) ----------

#: Rows of a block side at most when the caller names no size, and those compared at once.
SILHOUETTE_ROWS, SLICE_ROWS = 16384, 1024


def _label_distance_sums(a: pd.DataFrame, b: pd.DataFrame, ks: list[int], mirrored: bool = False) -> pd.DataFrame:
    """(grp, a_id, a_seg, b_seg, sum_d, cnt) for every k, from one block of distances; ``mirrored``: also with
    the sides swapped, for blocks that share no row."""
    none = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("grp", "a_id", "a_seg", "b_seg", "sum_d", "cnt")})
    if a.empty or b.empty:
        return none
    A = np.vstack(a["features"].to_numpy()).astype(np.float64)
    B = np.vstack(b["features"].to_numpy()).astype(np.float64)
    a_ids, b_ids = a["entity_id"].to_numpy(), b["entity_id"].to_numpy()

    def carried(side: pd.DataFrame) -> tuple[list, np.ndarray]:
        """(k, label) of a side and the 0-1 matrix (row, label): one product serves all k."""
        named = []
        for k in ks:
            lab = side[f"_s{k}"].to_numpy()
            named += [(k, one, lab == one) for one in pd.unique(lab[~pd.isna(lab)])]
        return named, np.column_stack([m for _, _, m in named]).astype(np.float64) if named else np.empty((len(side), 0))

    b_named, b_hot = carried(b)
    a_named, a_hot = carried(a) if mirrored else ([], np.empty((len(a), 0)))
    a_sums, b_sums = np.empty((len(a), len(b_named))), np.zeros((len(b), len(a_named)))
    for lo in range(0, len(a), SLICE_ROWS):
        part = slice(lo, lo + SLICE_ROWS)
        D = euclidean(A[part], B)
        if not mirrored:
            D[a_ids[part][:, None] == b_ids[None, :]] = 0.0
        a_sums[part] = D @ b_hot
        b_sums += D.T @ a_hot[part]
    outs = []
    for side, ids, named, sums in ((a, a_ids, b_named, a_sums), (b, b_ids, a_named, b_sums)):
        for at, (k, one, m) in enumerate(named):
            lab = side[f"_s{k}"].to_numpy()
            own = ~pd.isna(lab)
            outs.append(pd.DataFrame({"grp": k, "a_id": ids[own], "a_seg": lab[own], "b_seg": one, "sum_d": sums[own, at], "cnt": int(m.sum())}))
    return pd.concat(outs, ignore_index=True) if outs else none


def silhouette(vecs: DataFrame, labels: DataFrame, features: str = "features",
               block_rows: int | None = None) -> DataFrame:
    """M10 exact mode: mean (b - a) / max(a, b) with Euclidean distance, per k.

    Tasks for pairs of blocks (each pair once) compute each distance once and emit, per row and k, one
    (distance sum, count) per label of the other block; a groupBy merges them.  A singleton cluster scores 0 (the usual
    convention).  labels: (k, entity_id, segment).
    """
    ks = sorted(r["k"] for r in labels.select("k").distinct().collect())   # a number per k
    seg_type = labels.schema["segment"].dataType
    wide = labels.groupBy("entity_id").agg(*[F.max(F.when(F.col("k") == k, F.col("segment"))).alias(f"_s{k}") for k in ks],
                                           F.lit(0).alias("grp"))
    base = wide.join(vecs.select("entity_id", F.col(features).alias("features")), "entity_id")
    sizes = None
    if block_rows is None:
        # larger blocks for more rows: less to shuffle and to merge, a slice of distances at a time
        sizes = {0: base.count()}
        block_rows = min(SILHOUETTE_ROWS, max(DEFAULT_BLOCK_ROWS, -(-sizes[0] // 12)))
    tasks = block_pair_tasks(base, block_rows, group_sizes=sizes).where(F.col("ablk") <= F.col("bblk"))
    schema = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("a_id", base.schema["entity_id"].dataType),
                           T.StructField("a_seg", seg_type), T.StructField("b_seg", seg_type),
                           T.StructField("sum_d", T.DoubleType()), T.StructField("cnt", T.LongType())])

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["is_left"].to_numpy(dtype=bool)
        # rows with equal ids lie in one block
        return _label_distance_sums(pdf[left], pdf[~left], ks, mirrored=int(key[1]) < int(key[2]))

    sums = apply_in_groups(tasks, ["grp", "ablk", "bblk"], task, schema)
    per = sums.groupBy("grp", "a_id", "a_seg", "b_seg").agg(F.sum("sum_d").alias("s"), F.sum("cnt").alias("c"))
    own = F.when(F.col("a_seg") == F.col("b_seg"), F.try_divide(F.col("s"), F.col("c") - 1))
    other = F.when(F.col("a_seg") != F.col("b_seg"), F.col("s") / F.col("c"))
    row = per.groupBy("grp", "a_id").agg(F.max(own).alias("a"), F.min(other).alias("b"),
                                         F.max(F.when(F.col("a_seg") == F.col("b_seg"), F.col("c"))).alias("size"))
    s = (F.when((F.col("size") <= 1) | F.col("b").isNull(), F.lit(0.0))
         .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))
    return row.groupBy(F.col("grp").alias("k")).agg(F.avg(s).alias("silhouette"))


def fast_silhouette(predictions: DataFrame, features_col: str = "features_vec", prediction: str = "prediction",
                    metric: str = "squaredEuclidean") -> float:
    """M10 default mode: MLlib's linear-time silhouette (squared Euclidean or cosine)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol=prediction, metricName="silhouette",
                             distanceMeasure=metric)
    return ev.evaluate(predictions)
