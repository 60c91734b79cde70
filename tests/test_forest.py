"""The random forest keeps rows' nodes between levels, with the importances of a forest that looks for them."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from lookalike.config import AnalysisConfig
from lookalike.operators import ml


def test_forest_keeps_nodes_of_rows(spark, monkeypatch):
    made = []

    def recorded(**params):
        made.append(RandomForestClassifier(**params))
        return made[-1]
    monkeypatch.setattr(ml, "RandomForestClassifier", recorded)
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist(), float(x[0] + x[1] > 0)) for i, x in enumerate(rng.normal(size=(300, 3)))]
    data = spark.createDataFrame(rows, "entity_id long, x array<double>, label double").withColumn(ml.VEC, array_to_vector("x")).repartition(3)
    cfg = AnalysisConfig(forest_trees=8)
    got = {r["feature"]: r["importance"] for r in ml.forest_importance(data, list("abc"), cfg).collect()}
    assert made[0].getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=8, maxDepth=cfg.forest_depth, seed=cfg.seed, featuresCol=ml.VEC, labelCol="label").fit(data)
    assert [got[f] for f in "abc"] == pytest.approx(plain.featureImportances.toArray().tolist())
