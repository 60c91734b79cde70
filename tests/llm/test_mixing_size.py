"""The size of the raked sample."""

import pytest

from lookalike.llm import raking


def cells(spark):
    rows = [("a", "en", "prose", 60_000), ("a", "de", "prose", 25_000), ("b", "en", "prose", 15_000), ("b", "en", "code", 2)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_a_tiny_cell_does_not_set_the_size(spark):
    got = {(r["source"], r["lang"], r["topic"]): r for r in raking.rake(cells(spark)).collect()}
    kept = sum(r["tokens"] * r["probability"] for r in got.values()) / 100_002
    assert kept > 0.8  # the cell of two tokens has about three times the factor of any other
    tiny = got.pop(("b", "en", "code"))
    assert tiny["probability"] == 1.0 and tiny["shortfall"] > 0
    assert all(r["shortfall"] == 0 for r in got.values())
    rates = [r["probability"] / r["factor"] for r in got.values()]
    assert rates == pytest.approx([rates[0]] * len(rates))


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.95, 1.0])
def test_the_wanted_share_is_kept(spark, keep):
    got = raking.rake(cells(spark), raking.RakingConfig(keep=keep)).collect()
    assert sum(r["tokens"] * r["probability"] for r in got) == pytest.approx(keep * 100_002)
    assert all(0 < r["probability"] <= 1 and r["shortfall"] >= 0 for r in got)


def test_sizes_out_of_range_are_refused():
    for keep in (0, -0.1, 1.5):
        with pytest.raises(ValueError):
            raking.RakingConfig(keep=keep)
