"""Preprocessing: what the isolation forest finds extreme goes on rescaled."""

import numpy as np
import pytest

from lookalike.config import AnalysisConfig
from lookalike.plans import pipeline


def test_extreme_rows_go_on_rescaled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 3))
    x[:9] *= 6
    ids = [None if i == 3 else f"t{i % 80}" for i in range(90)]          # some ids come twice, one is missing
    df = spark.createDataFrame([(e, *map(float, r)) for e, r in zip(ids, x)], "entity_id string, a double, b double, c double")
    cfg = AnalysisConfig(extreme_score=-0.02, isolation_trees=20)
    plain = pipeline.preprocess(df, cfg, isolation=False).table.toPandas()
    pre = pipeline.preprocess(df, cfg)
    got = pre.table.toPandas()
    assert pre.features == ["a", "b", "c"] and len(got) == len(plain) == 90
    # every row's score, by its own values: those that are not changed are found again
    scored = pre.artefacts["isolation_forest"].toPandas()
    assert len(scored) == 90
    extreme = int((scored["outlier_score"] < cfg.extreme_score).sum())
    assert 1 < extreme < 20
    key = lambda t: {tuple(r) for r in t[["a", "b", "c"]].round(9).itertuples(index=False)}
    kept = key(plain) & key(got)
    assert len(kept) == 90 - extreme
    gone = np.array(sorted(key(plain) - kept))
    q1, mid, q3 = np.quantile(gone, [0.25, 0.5, 0.75], axis=0)
    want = np.array(sorted(map(tuple, (gone - mid) / np.where(q3 > q1, q3 - q1, 1.0))))
    assert np.array(sorted(key(got) - kept)) == pytest.approx(want, abs=1e-6)


def test_donors_are_searched_once(spark, monkeypatch):
    """What follows the imputation reads its rows from a checkpoint; the source is read once, too."""
    rng = np.random.default_rng(12)
    rows = [(i, *(None if rng.random() < share else float(v) for v, share in zip(rng.normal(size=3), (0.05, 0.3, 0.0)))) for i in range(120)]
    read, searched = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(counter):
        def passed(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch
        return passed
    df = spark.createDataFrame(rows, "entity_id long, a double, b double, c double")
    df = df.mapInArrow(counting(read), df.schema)
    knn = pipeline.impute.knn_impute

    def impute(table, *args, **kw):
        out = knn(table, *args, **kw)
        return out.mapInArrow(counting(searched), out.schema)
    monkeypatch.setattr(pipeline.impute, "knn_impute", impute)
    pre = pipeline.preprocess(df, AnalysisConfig(isolation_trees=5))
    assert pre.table.count() == 120
    assert read.value == 120 and searched.value == 120
