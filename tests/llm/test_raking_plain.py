"""Cell weights and probabilities against a plain iterative proportional fitting."""

import random

import numpy as np
import pytest

from lookalike.llm import raking


def plain(cells, smoothing, targets):
    """(weights, probabilities) of cells {(source, lang, topic): tokens}, by loops over arrays."""
    names = sorted(cells, key=str)
    mass = np.array([float(cells[n]) for n in names])
    weight = mass / mass.sum()
    for _ in range(2000):
        for d, dim in enumerate(raking.DIMENSIONS):
            values = sorted({n[d] for n in names}, key=str)
            own = np.array([mass[[n[d] == v for n in names]].sum() for v in values])
            goal = np.array([targets[dim].get(v, 0.0) for v in values]) if dim in targets else own ** smoothing
            for v, g in zip(values, goal / goal.sum()):
                mine = np.array([n[d] == v for n in names])
                if weight[mine].sum() > 0:
                    weight[mine] *= g / weight[mine].sum()
    factor = weight / mass
    real = mass >= raking.RakingConfig().real_cell * mass.sum()
    return dict(zip(names, zip(weight, np.minimum(factor / factor[real].max(), 1.0))))


@pytest.mark.parametrize("targets", [{}, {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "de": 0.5, "absent": 0.2}}])
def test_weights_equal_a_plain_fit(spark, targets):
    rng = random.Random(7)
    cells = {(s, lang, t): rng.randrange(1, 5000) for s in "ab" for lang in ("en", "de") for t in ("x", "y", None) if rng.random() < 0.95}
    cells["b", "de", "z"] = 1
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    config = raking.RakingConfig(targets=targets, tolerance=1e-10)
    got = {(r["source"], r["lang"], r["topic"]): r for r in raking.rake(df, config).collect()}
    want = plain(cells, config.smoothing, targets)
    assert got.keys() == want.keys()
    for name, (weight, probability) in want.items():
        assert got[name]["weight"] == pytest.approx(weight, abs=1e-8) and got[name]["probability"] == pytest.approx(probability, abs=1e-6)
        assert got[name]["max_error"] <= 1e-10


def test_unreachable_targets_are_reported(spark):
    rows = [(i, "some words here", "en", "a") for i in range(5)] + [(9, "more words", "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    config = raking.RakingConfig(targets={"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.2, "b": 0.8}}, max_rounds=8)
    with pytest.warns(UserWarning, match="raking ended"):
        out = raking.mix(df, config).collect()
    assert all(r["max_error"] > 0.1 for r in out)
