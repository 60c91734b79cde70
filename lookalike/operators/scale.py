"""C11 standardize and D4 weight_features: fit once (one aggregate), apply as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StandardizerModel:
    """Per-feature mean and population std learned on one table, applicable to another."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in (keep if keep is not None else df.columns) if c not in self.features]
        scaled = []
        for f, m, s in zip(self.features, self.means, self.stds):
            # constant (or all-NULL) feature; the relative bound absorbs rounding noise in the
            # combined moments of an exactly constant column
            if s is None or m is None or s <= 1e-12 * max(1.0, abs(m)):
                scaled.append(F.when(F.col(f).isNull(), F.lit(None)).otherwise(F.lit(0.0)).alias(f))
            else:
                scaled.append(((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).alias(f))
        return df.select(*[F.col(f"`{c}`") for c in keep], *scaled)


#: Groups whose moments may be read back (a few numbers per feature each).
GROUPS_READ = 1000


def fit_standardizer(df: DataFrame, features: list[str]) -> StandardizerModel:
    """One aggregate over all features; the result is 2 numbers per feature."""
    if not features:
        return StandardizerModel((), (), ())
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return StandardizerModel(tuple(features), tuple(row[f"m{i}"] for i in range(len(features))),
                             tuple(row[f"s{i}"] for i in range(len(features))))


def fit_standardizer_by_group(df: DataFrame, features: list[str], group: str):
    """One aggregate per group (count, mean and population M2 of every feature) combined on the
    driver with the pairwise update of Chan et al.: the overall standardizer *and* the group
    sizes from a single pass.  Beyond GROUPS_READ groups the model comes from one aggregate over all
    rows instead, and no sizes are returned."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(features):
        aggs += [F.count(f).alias(f"c{i}"), F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}")]
    rows = df.groupBy(group).agg(*aggs).limit(GROUPS_READ + 1).collect()
    if len(rows) > GROUPS_READ:
        return fit_standardizer(df, features), None
    means, stds = [], []
    for i in range(len(features)):
        n, mean, m2 = 0, 0.0, 0.0
        for r in rows:
            nb = r[f"c{i}"]
            if not nb:
                continue
            mb, m2b = r[f"m{i}"], r[f"v{i}"] * nb
            delta = mb - mean
            tot = n + nb
            mean += delta * nb / tot
            m2 += m2b + delta * delta * n * nb / tot
            n = tot
        means.append(mean if n else None)
        stds.append((m2 / n) ** 0.5 if n else None)
    sizes = {r[group]: r["_n"] for r in rows}
    return StandardizerModel(tuple(features), tuple(means), tuple(stds)), sizes


def standardize(df: DataFrame, features: list[str], model: StandardizerModel | None = None) -> DataFrame:
    """C11: z-score with population std; constant → 0.  Non-feature columns pass through."""
    model = model or fit_standardizer(df, features)
    return model.transform(df)


def weight_features(df: DataFrame, features: list[str], weights: dict[str, float] | None = None,
                    default: float = 1.0) -> DataFrame:
    """Multiply each feature by its weight (default 1.0)."""
    weights = weights or {}
    return df.select(*[
        (F.col(c) * F.lit(float(weights.get(c, default)))).alias(c) if c in features else F.col(f"`{c}`")
        for c in df.columns])
