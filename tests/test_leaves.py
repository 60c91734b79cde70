import numpy as np
import pandas as pd
import pytest

from lookalike.operators import impute, leaves, similarity
from lookalike.operators.similarity import topk_similarity


def rows_with_copies(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:5] = 0
    x[100:250] = x[50]
    x[250:400] = rng.normal(size=(15, d))[rng.integers(0, 15, 150)]
    return pd.DataFrame({"entity_id": rng.permutation(n), "region": rng.integers(0, 3, n), "features": list(x)})


def plain(t, k, rule, per_region, floor):
    u = similarity._unit_rows(np.vstack(t.features))
    ids, regions, out = t.entity_id.to_numpy(), t.region.to_numpy(), []
    for i in range(len(t)):
        s = leaves.exact_dot(np.repeat(u[i:i + 1], len(u), 0), u)
        ok = (ids != ids[i]) & (s >= (-2 if floor is None else floor))
        ok &= regions[i] < regions if rule == "lt" else regions[i] != regions if rule == "ne" else True
        for region in np.unique(regions) if per_region else [None]:
            at = np.flatnonzero(ok if region is None else ok & (regions == region))
            out += [(ids[i], ids[j]) for j in at[np.lexsort((ids[at], -s[at]))[:k]]]
    return sorted(out)


@pytest.mark.parametrize("rule,per_region,floor", [("lt", True, 0.0), ("ne", False, 0.5), ("any", False, None), ("any", True, None)])
def test_ties_go_to_the_lower_id_whatever_the_leaves(rule, per_region, floor, monkeypatch):
    t = rows_with_copies(900, 4)
    monkeypatch.setattr(leaves, "FIRST_ROWS", 64)
    monkeypatch.setattr(leaves, "BATCH_ROWS", 128)
    monkeypatch.setattr(leaves, "TIED", 2)
    got = similarity._local_topk(t, t, 4, rule, per_region, floor, True)
    assert sorted(zip(got.a_id, got.b_id)) == plain(t, 4, rule, per_region, floor)


def test_far_leaves_are_not_visited():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(20_000, 3))
    seen = []
    t = leaves.Targets.of(x, np.arange(len(x)), np.arange(len(x)))
    order, bounds = leaves.cut(x)
    parts = [order[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])][:3]

    def keep(r, c):
        seen.append(np.size(c))
        return r != c
    r, c, s = leaves.nearest(x, t, 5, "euclidean", parts, keep=keep)
    asked = np.concatenate(parts)
    far = np.sqrt(((x[asked][:, None] - x[None]) ** 2).sum(2))
    far[np.arange(len(asked)), asked] = np.inf
    assert np.allclose(np.sort(-s), np.sort(np.sort(far, axis=1)[:, :5].ravel())) and len(r) == 5 * len(asked)
    assert max(seen) < len(x) / 4


def test_blocks_grow_with_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "entity_id long, region int, features array<double>")
    stats = {}
    got = topk_similarity(df, k=2, block_rows=8, stats=stats)
    assert got.count() == 3000
    assert stats["block_pairs"] <= (3 * similarity.MOST_BLOCKS) ** 2      # 188 blocks of 8 rows before


def donors(n, rng, missing):
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[50:200] = x[10]
    x[rng.random(x.shape) < missing] = np.nan
    x[:3] = np.nan
    return pd.DataFrame({"entity_id": rng.permutation(n), **{c: x[:, i] for i, c in enumerate("abcd")}})


@pytest.mark.parametrize("missing,infinite", [(0.05, False), (0.4, False), (0.1, True)])
def test_donor_search_equals_the_dense_one(missing, infinite, monkeypatch):
    rng = np.random.default_rng(5)
    t = donors(1300, rng, missing)
    if infinite:
        t.loc[7, "b"] = np.inf
    incomplete = t[t[list("abcd")].isna().any(axis=1)]
    key = ["entity_id", "feature", "dist", "donor"]
    want = impute._dense_block(incomplete, t, 5, list("abcd")).sort_values(key, ignore_index=True)
    calls, dense = [], impute._dense_candidates
    monkeypatch.setattr(impute, "_dense_candidates", lambda *a: calls.append(1) or dense(*a))
    monkeypatch.setattr(impute, "KNN_BLOCK_ROWS", 500)
    monkeypatch.setattr(impute, "SET_PAIRS", 1)
    got = impute._donor_candidates(incomplete, t, 5, list("abcd")).sort_values(key, ignore_index=True)
    kept = got.groupby(["entity_id", "feature"]).head(5).reset_index(drop=True)     # the window's work
    pd.testing.assert_frame_equal(kept[want.columns], want, check_exact=True)
    assert bool(calls) == infinite
