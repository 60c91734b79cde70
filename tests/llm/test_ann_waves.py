"""Queries stream past opened shards: many shards, blocks and waves give what one of each gives."""

import numpy as np

from lookalike.llm import graph_ann


def test_waves_lose_no_query(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "BLOCKS_PER_WAVE", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.toDF("vec_id", [f.name for f in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").schema.fields][1])
    config = graph_ann.GraphConfig(shard_rows=100, query_rows=20)
    got = graph_ann.nearest(df, 10, 3, config).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 600, 3)) and (got.groupby("query_id").size() == 10).all()
    scores = x @ x.T
    hits = 0
    for q, part in got.groupby("query_id"):
        s = scores[q].copy()
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10]) & set(part.vec_id))
        assert np.allclose(part.sort_values("rank").score, scores[q][part.sort_values("rank").vec_id])
    assert hits >= 0.95 * 10 * 200
