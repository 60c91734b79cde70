import numpy as np
import pytest

from lookalike.operators import graph, within


def scattered(n, d=3, seed=0):
    """Clusters, copies, and lone rows; coordinates on a grid of 0.25, so that distances meet the limit exactly."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, d)), rng.normal(4, 0.4, size=(n // 4, d)), rng.uniform(-9, 9, size=(n - n // 2 - n // 4, d))])
    x = np.round(x * 4) / 4
    x[n // 8:n // 6] = x[0]
    return x


def plain(rows, eps, least):
    """{(id, segment, is_core)} by all pairs; the rows of an id count together and are one node."""
    ids = np.array([r[0] for r in rows])
    x = np.array([[np.nan if v is None else v for v in r[1]] for r in rows], float)
    ok = np.isfinite(x).all(axis=1)
    near = np.zeros((len(x), len(x)), bool)
    near[np.ix_(ok, ok)] = np.sqrt(((x[ok][:, None] - x[ok][None]) ** 2).sum(2)) <= eps
    held, at = np.unique(ids, return_inverse=True)
    n = np.bincount(at, near.sum(1))
    core = n[at] >= least
    link = np.zeros((len(held), len(held)), bool)
    i, j = np.nonzero(near & core[:, None] & core[None, :])
    link[at[i], at[j]] = True
    label = np.arange(len(held))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(held)).min(axis=1, initial=len(held)))
        if (new == label).all():
            break
        label = new
    out = set()
    for k, one in enumerate(held):
        mine = at == k
        cores = at[near[mine].any(axis=0) & core]
        segment = held[label[k]] if core[mine][0] else held[label[cores.min()]] if len(cores) else -1
        out.add((int(one), int(segment), bool(core[mine][0])))
    return out


@pytest.mark.parametrize("block_rows,least", [(60, 5), (4096, 5), (100, 1)])
def test_density_segments_equal_all_pairs(spark, block_rows, least):
    x = scattered(400)
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(1).permutation(400), x)]
    rows += [(7, [4.0, 4.0, 4.0]), (9, [-8.75, 8.0, 8.5])]          # ids that come twice
    df = spark.createDataFrame(rows, "entity_id long, features array<double>")
    got = graph.density_segments(df, eps=0.75, min_samples=least, block_rows=block_rows).collect()
    assert {tuple(r) for r in got} == plain(rows, 0.75, least)


def test_incomplete_vectors_are_noise_and_harm_no_others(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    odd = [(90, [float("nan"), 0.0]), (91, [None, 0.0]), (92, None), (93, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + odd, "entity_id long, features array<double>")
    got = {r["entity_id"]: (r["segment"], r["is_core"]) for r in graph.density_segments(df, eps=0.5, min_samples=5, block_rows=8).collect()}
    assert all(got[i] == (i % 3, True) for i in range(30)) and all(got[i] == (-1, False) for i, _ in odd)
    alone = graph.density_segments(df.where("entity_id > 89"), eps=0.5).collect()
    assert {tuple(r) for r in alone} == {(i, -1, False) for i, _ in odd}


def test_rows_without_ids_are_neighbours_but_no_result(spark):
    rows = [(None, [0.0]), (None, [0.1]), (2 ** 60 + 1, [0.2]), (5, [9.0])]
    df = spark.createDataFrame(rows, "entity_id long, features array<double>")
    got = {tuple(r) for r in graph.density_segments(df, eps=0.5, min_samples=3, block_rows=2).collect()}
    assert got == {(2 ** 60 + 1, 2 ** 60 + 1, True), (5, -1, False)}


def test_counts_and_joins_equal_all_pairs():
    x, y = scattered(700, seed=3), scattered(500, seed=4)
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) <= 0.75
    slack, (a, b) = within.sides(0.75, x, y)
    assert (within.count(a, b, 0.75, 6, slack) == np.minimum(far.sum(1), 6)).all()
    rank = np.random.default_rng(5).permutation(500)
    assert (within.first_near(a, b, rank, 0.75, slack) == np.where(far, rank[None, :], 500).min(axis=1)).all()
    root = within.join(a, b, np.arange(700), np.arange(700, 1200), 1200, 0.75, slack)
    i, j = np.nonzero(far)
    assert (root[i] == root[700 + j]).all() and len(np.unique(root)) == len(np.unique(_joined(1200, i, 700 + j)))


def _joined(n, i, j):
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        if (low == label).all():
            return label
        label = low


def test_dense_rows_are_not_compared_pair_by_pair(monkeypatch):
    x = np.random.default_rng(6).normal(size=(20_000, 3))
    seen, near = [], within._near
    monkeypatch.setattr(within, "_near", lambda a, rows, b, cols, *rest: seen.append(len(rows) * len(cols)) or near(a, rows, b, cols, *rest))
    slack, (a,) = within.sides(0.6, x)
    n = within.count(a, a, 0.6, 5, slack)
    core = n >= 5
    assert core.mean() > 0.98 and sum(seen) < len(x) ** 2 / 8
    seen.clear()
    slack, (a,) = within.sides(0.6, x[core])
    number = np.arange(int(core.sum()))
    root = within.join(a, a, number, number, len(number), 0.6, slack)
    assert (root == 0).mean() > 0.99 and sum(seen) < len(x) ** 2 / 8


def test_cells_hold_about_as_many_rows_each():
    x = np.random.default_rng(7).normal(size=(20_000, 4))
    x[:5_000] = x[0]                # a cell of equal rows can't be cut
    tree = within.Cells.of(x, 16)
    cells, sizes = np.unique(tree.cell(x), return_counts=True)
    assert 8 <= len(cells) <= 32 and np.sort(sizes)[-2] < 2 * 20_000 / 16 and sizes.max() < 5_000 + 20_000 / 8
