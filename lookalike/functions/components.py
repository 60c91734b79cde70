"""Connected components of a table of links, by alternating star contraction.

Every round hangs the larger neighbours of a node on its smallest neighbour, then the smaller ones;
the number of rounds grows with the logarithm of the longest path, and rounds go on until nothing
changes.  Rounds are reliable checkpoints; nothing but counts and checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(
        F.col("a") != F.col("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())


def components(links: DataFrame, keep=cut_lineage) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b of one type); the component is its
    smallest node.  Rows with a = b are ignored.  ``keep`` cuts the lineage of a round."""
    now = keep(_small_star(links.select("a", "b").where(F.col("a") != F.col("b")).distinct()))
    mark = _mark(now)
    while mark[0]:
        now = keep(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
