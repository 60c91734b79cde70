"""Exact quantiles (linear interpolation) of many features by radix narrowing.

A double is read as a 64-bit integer of the same order (sign, exponent, mantissa), computed by
exact arithmetic inside the query.  A pass counts the values of every feature by a digit of that integer, with
partial aggregation, and running sums over the few digits tell in which cells the wanted ranks
lie, for all features and ranks together.  The next pass looks at those cells only and splits them by the
next digit.  As soon as the wanted cells hold at most ``LAST_VALUES`` values, the next pass counts the
values themselves and is the last.  There is one plan at every size: ``len(SHIFTS)`` scans at
most (sign, exponent and 8 bits of the mantissa; then 16, 16 and 12 bits), usually two; a task sees at
most a feature's cells of one pass, and a value that a third of the rows hold is one row.

Edge cases: NULLs don't count; NaN is larger than any number; -0.0 equals 0.0; a feature without
values gives None; equal values and infinite ones are values like any other; an empty table gives
None for every feature.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Low bits that a pass leaves open.
SHIFTS = (44, 28, 12, 0)
#: Values in wanted cells that one more pass counts one by one.
LAST_VALUES = 1_000_000


def ordered_bits(v):
    """64-bit integer of a double column in the order of the doubles; both zeros are 0."""
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("double")
    # the logarithm may be off by one at powers of two; powers and their quotients are exact
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(
        (guess < 1023) & (F.pow(F.lit(2.0), F.least(guess + 1, F.lit(1023.0))) <= size), guess + 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 52)
    normal = (power.cast("bigint") + 1023) * F.lit(1 << 52) + fraction.cast("bigint")
    below = (size * 2.0 ** 537 * 2.0 ** 537).cast("bigint")           # subnormal numbers
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0 ** -1022, below).otherwise(normal)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -bits).otherwise(bits)


def quantiles(df: DataFrame, features: list[str], probs: list[float], approx: bool = False,
              last_values: int = LAST_VALUES, exact_rank: bool = False) -> dict:
    """{feature: [q(p) for p in probs]} (None for a feature without values).  ``exact_rank``: the smallest value that
    a share of at least p does not exceed, instead of an interpolated one."""
    if not features:
        return {}
    probs = [float(p) for p in probs]
    if approx:
        row = df.agg(*[F.percentile_approx(f, F.array(*[F.lit(p) for p in probs]), 10000).alias(f)
                       for f in features]).first()
        return {f: (None if row[f] is None else [float(v) for v in row[f]]) for f in features}
    spark = df.sparkSession
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v"))
                                           for i, f in enumerate(features)])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    values = values.withColumn("key", ordered_bits(F.col("v")))
    by_feature = Window.partitionBy("feature")
    # 0-based ranks around p (n - 1); a cell's first rank counts the values before it
    around = F.array(*[f((F.col("n") - 1) * p).cast("bigint") for p in probs for f in (F.floor, F.ceil)])
    if exact_rank:
        around = F.array(*[F.greatest(F.ceil(F.col("n") * p).cast("bigint") - 1, F.lit(0).cast("bigint")) for p in probs])
    cells, known, sizes = None, {}, {}
    for at, shift in enumerate(SHIFTS):
        last = shift == 0 or (cells is not None and sum(c["count"] for c in cells) <= last_values)
        shift = 0 if last else shift
        if cells is None:
            inside = values.withColumn("before", F.lit(0).cast("bigint")).withColumn("cell", F.lit(0).cast("bigint"))
        else:
            # at most 2 cells per feature and wanted quantile
            wanted = spark.createDataFrame([(c["feature"], c["at"], c["first"]) for c in cells], "feature int, cell long, before long")
            inside = values.withColumn("cell", F.shiftright("key", SHIFTS[at - 1])).join(F.broadcast(wanted), ["feature", "cell"])
        counted = inside.groupBy("feature", "cell", "before", F.shiftright("key", shift).alias("at")).agg(
            F.count(F.lit(1)).alias("count"), F.min("v").alias("v"))
        running = Window.partitionBy("feature", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("first", F.col("before") + F.coalesce(F.sum("count").over(running), F.lit(0)))
        if cells is None:
            counted = counted.withColumn("n", F.sum("count").over(by_feature))
        else:
            rows = spark.createDataFrame(sorted(sizes.items()), "feature int, n long")
            counted = counted.join(F.broadcast(rows), "feature")
        ranks = around
        cells = counted.where(F.exists(ranks, lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("count")))).select(
            "feature", "at", "first", "count", "n", "v").collect()
        sizes = {c["feature"]: c["n"] for c in cells}
        if last or not cells:
            for c in cells:
                known.setdefault(c["feature"], []).append((c["first"], c["first"] + c["count"], c["v"]))
            break
    out = {}
    for i, f in enumerate(features):
        if i not in sizes:
            out[f] = None
            continue

        def value(rank: int) -> float:
            return next(v for lo, hi, v in known[i] if lo <= rank < hi)
        out[f] = []
        for p in probs:
            pos = max(math.ceil(sizes[i] * p) - 1, 0) if exact_rank else p * (sizes[i] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = value(lo), value(hi)
            out[f].append(a if a == b else (hi - pos) * a + (pos - lo) * b)
    return out
