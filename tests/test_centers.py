"""Shared k-means scans against separate plain runs."""

import numpy as np
from pyspark.ml.functions import array_to_vector

from lookalike.config import AnalysisConfig
from lookalike.operators import centers, ml


def frame(spark, x):
    df = spark.createDataFrame([(f"0{i}", r.tolist()) for i, r in enumerate(x)], "entity_id string, x array<double>")
    return df.select("entity_id", array_to_vector("x").alias(ml.VEC)).repartition(5)


def lloyd(x, start, rounds=300):
    c = start.copy()
    for i in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        near, cost = d.argmin(1), d.min(1).sum()
        moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.sqrt(((moved - c) ** 2).sum(1).max()) <= centers.TOLERANCE:
            return c, cost, i + 1
        c = moved
    return c, cost, rounds + 1


def test_all_models_equal_separate_runs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 1.0, (60, 3)) for m in (0, 4, 9)])
    vecs = frame(spark, x)
    ks, starts = [2, 3, 5], 4
    fitted, scans = centers.fit_all(vecs, ks, starts, 42, 300, ml.VEC)
    rows = vecs.select(ml.vector_to_array(ml.VEC).alias("x"))
    first = centers.draw_centres(rows, 5, starts, 42)
    slowest = 0
    for s in range(starts):
        assert len(np.unique(first[s], axis=0)) == 5 and all((x == c).all(1).any() for c in first[s])
        for k in ks:
            c, cost, n = lloyd(x, first[s][:k])
            assert np.allclose(fitted[k, s].centres, c) and np.isclose(fitted[k, s].cost, cost)
            slowest = max(slowest, n)
    assert scans == slowest
    sweep = ml.kmeans_sweep(vecs, ks, starts, AnalysisConfig())
    assert sweep.costs == {k: min(fitted[k, s].cost for s in range(starts)) for k in ks}
    long = sweep.labels(vecs).toPandas()
    one = sweep.models[3].transform(vecs).toPandas()
    assert dict(zip(one.entity_id, one.prediction)) == dict(zip(*long[long.k == 3][["entity_id", "segment"]].to_numpy().T))


def test_fewer_distinct_rows_than_centres(spark):
    x = np.array([[0.0, 0.0]] * 20 + [[1.0, 1.0]] * 3)
    sweep = ml.kmeans_sweep(frame(spark, x), [4], 2, AnalysisConfig())
    assert len(sweep.models[4].centres) == 2 and sweep.costs[4] == 0.0


def test_rows_are_packed_once_and_dealt_to_the_cores(spark):
    x = np.random.default_rng(5).normal(size=(300, 4))
    rows = frame(spark, x).coalesce(1).select(ml.vector_to_array(ml.VEC).alias("x"))
    packed = centers.packed(rows)
    got = packed.collect()
    assert packed.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and len(got) < 100
    back = np.vstack([np.frombuffer(r["x"], float).reshape(-1, r["d"]) for r in got])
    assert sorted(map(tuple, back)) == sorted(map(tuple, x))
    assert all((p == q).all() for p, q in zip(centers.draw_centres(packed, 3, 2, 1), centers.draw_centres(rows, 3, 2, 1)))


def test_sums_of_several_models_and_of_ties(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [5.0, 1.0]])
    table, total = np.array([[0.0, 0.0], [2.0, 0.0], [5.0, 1.0]]), np.zeros((3, 4))
    centers._add_up(total, x, table, [0, 2, 3])    # models of 2 centres and of 1
    assert total[:, 0].tolist() == [2, 2, 4] and total[0, 2:].tolist() == [1, 0] and total[1, 2:].tolist() == [7, 1]
    assert total[:2, 1].sum() == 1 + 9 + 1 and total[2, 1] == 26 + 17 + 10
