"""The search queries run the library's whole search."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from lookalike.config import AnalysisConfig
from lookalike.operators import classify, evaluate
from lookalike.plans import catalog


def test_queries_search_the_whole_grid(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "_labelled", lambda spark, d: None)
    monkeypatch.setattr(catalog, "_round", lambda df: df)
    monkeypatch.setattr(catalog, "_ef", lambda spark, d: SimpleNamespace(drop=lambda name: None))
    monkeypatch.setattr(classify, "grid_search", lambda df, grid, *a: seen.append(grid) or SimpleNamespace(params={}, score=0.0))
    monkeypatch.setattr(catalog.pipeline, "run_segmentation",
                        lambda df, cfg, grid: seen.extend([cfg, grid]) or SimpleNamespace(summary=SimpleNamespace(drop=lambda c: None)))
    catalog.q_grid_search(SimpleNamespace(createDataFrame=lambda *a: None), "")
    catalog.q_run_segmentation(None, "")
    assert seen == [classify.DEFAULT_GRID, AnalysisConfig(), classify.DEFAULT_GRID]


def test_silhouette_takes_each_pair_of_blocks_once():
    rng = np.random.default_rng(2)
    side = lambda first, n: pd.DataFrame({"entity_id": np.arange(first, first + n), "features": list(rng.normal(size=(n, 3))),
                                          "_s2": [None if i % 7 == 0 else i % 2 for i in range(n)], "_s3": np.arange(n) % 3})
    a, b = side(0, 1500), side(5000, 40)
    columns = ["grp", "a_id", "a_seg", "b_seg"]
    both = evaluate._label_distance_sums(a, b, [2, 3], mirrored=True).set_index(columns).sort_index()
    plain = pd.concat([evaluate._label_distance_sums(a, b, [2, 3]), evaluate._label_distance_sums(b, a, [2, 3])]).set_index(columns).sort_index()
    assert both.index.equals(plain.index) and (both["cnt"] == plain["cnt"]).all()
    assert np.allclose(both["sum_d"].astype(float), plain["sum_d"].astype(float))
