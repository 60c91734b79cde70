"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  ``rake`` scales the tokens of the cells in
turn so that the totals per source, per language and per topic reach their targets, again and
again until all three agree within ``tolerance``.  A cell's weight over its tokens is the factor
of its documents, and min(1, c * factor) the probability that a document is sampled.  The size c
comes from ``keep`` (share of the tokens wanted) or is the largest at which no cell of real weight
is capped; the expected mix is the raked one up to the ``shortfall`` of the capped cells, the
tokens that they have too few for that size.  A document is kept when a number drawn from the hash of its id and text lies below its probability: the sample
does not depend on partitioning, order or the number of rows.

Targets are shares per value and dimension; without them a dimension aims at its own token shares
raised to ``smoothing`` (below 1: rare values gain), normalised.  Only the cells are iterated on;
they are rows of a DataFrame, and a round is a chain of window sums over them.

Edge cases: NULL in any dimension is a value of its own; documents without words have no tokens,
take the factor of their cell, and cells without tokens get the smallest probability; a value with
target 0 is never sampled, a target value that no document has is left out; targets that no
weights can reach (empty combinations) end after ``max_rounds`` with a warning and the rest in
``max_error``;
repeated rows are sampled alike; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, text_or_empty, written

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class RakingConfig:
    smoothing: float = 0.9
    #: shares per dimension, e.g. {"lang": {"en": 0.6, "de": 0.4}}; absent: smoothed own shares
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    tolerance: float = 1e-6
    rounds_per_step: int = 4   #: rounds between two looks at the error (one job each)
    max_rounds: int = 400
    #: share of all tokens to keep; absent: the largest size that caps no cell of real weight
    keep: float | None = None
    real_cell: float = 0.0005  #: share of all tokens from which a cell has real weight

    def __post_init__(self):
        if self.keep is not None and not 0 < self.keep <= 1:
            raise ValueError(f"keep must be above 0 and at most 1, got {self.keep}")


def token_count(text):
    """Words of a text: maximal runs without blanks."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0b\x0c\r]+")).cast("bigint")


def topic_of(text):
    """Topic by form: the kind of text that its characters show (code, figures, list, dialogue,
    short, prose).  Callers with topic labels pass their own column instead."""
    n = F.greatest(F.char_length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return (F.when(share(r"[{}();=<>\[\]]") > 0.04, F.lit("code"))
            .when(share(r"[0-9]") > 0.06, F.lit("figures"))
            .when(share(r"\n") > 0.012, F.lit("list"))
            .when(share(r"[?!\"]") > 0.01, F.lit("dialogue"))
            .when(n < 600, F.lit("short"))
            .when(n < 4000, F.lit("prose")).otherwise(F.lit("long")))


def _targets(cells: DataFrame, dim: str, config: RakingConfig) -> DataFrame:
    """(dim, share) with shares summing to 1 over the values that occur."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("_n")).where(F.col("_n") > 0)
    if dim in config.targets:
        given = cells.sparkSession.createDataFrame(list(config.targets[dim].items()), f"`{dim}` string, _s double")
        own = own.join(given, own[dim].eqNullSafe(given[dim]), "left").select(own[dim], F.coalesce("_s", F.lit(0.0)).alias("_s"))
    else:
        own = own.select(dim, F.pow(F.col("_n").cast("double"), F.lit(config.smoothing)).alias("_s"))
    total = own.agg(F.sum("_s")).first()[0] or 1.0
    return own.select(F.col(dim).alias(f"_{dim}"), (F.col("_s") / F.lit(float(total))).alias(f"t_{dim}"))


def rake(cells: DataFrame, config: RakingConfig = RakingConfig(), dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``cells`` (dims, tokens) with weight, factor, probability, shortfall and max_error.

    Weights sum to 1 over the cells with tokens; shortfall is the tokens that a cell with probability
    1 lacks for its share; max_error is the largest distance of a dimension's share to its target
    when the rounds ended."""
    prepare(cells.sparkSession)
    live = cells.where(F.col("tokens") > 0)
    for dim in dims:
        goal = _targets(cells, dim, config)
        live = live.join(goal, live[dim].eqNullSafe(goal[f"_{dim}"])).drop(f"_{dim}")
    everything = live.agg(F.sum("tokens")).first()[0] or 1
    live = written(live.withColumn("weight", F.col("tokens") / F.lit(float(everything))), "raking-cells")
    total = {d: F.sum("weight").over(Window.partitionBy(d)) for d in dims}
    done, error = 0, None
    while True:
        worst = F.greatest(*[F.abs(total[d] - F.col(f"t_{d}")) for d in dims])
        error = live.select(worst.alias("e")).agg(F.max("e")).first()[0]
        if error is None or error <= config.tolerance or done >= config.max_rounds:
            break
        for _ in range(config.rounds_per_step):
            for d in dims:
                live = live.withColumn("weight", F.when(total[d] > 0, F.col("weight") * F.col(f"t_{d}") / total[d]).otherwise(F.lit(0.0)))
        done += config.rounds_per_step
        live = written(live, "raking-cells")
    if error is not None and error > config.tolerance:
        warnings.warn(f"raking ended after {done} rounds with an error of {error:.3g}", stacklevel=2)
    live = live.withColumn("factor", F.col("weight") / F.col("tokens"))
    rate = F.col("factor") / F.lit(_full_factor(live, config, float(everything)))
    return live.select(*dims, "tokens", "weight", "factor", F.least(rate, F.lit(1.0)).alias("probability"),
                       (F.greatest(rate - 1, F.lit(0.0)) * F.col("tokens")).alias("shortfall"),
                       F.lit(float(error or 0.0)).alias("max_error"))


def _full_factor(cells: DataFrame, config: RakingConfig, tokens: float) -> float:
    """The factor whose documents are just kept with probability 1 (1 / c)."""
    if config.keep is None:
        real = F.col("tokens") >= F.lit(config.real_cell * tokens)
        row = cells.agg(F.max(F.when(real, F.col("factor"))), F.max("factor")).first()
        return row[0] or row[1] or 1.0
    full, wanted = math.inf, config.keep * tokens
    while True:  # cells of larger factors are capped; with each round the rest has to give more
        capped = F.col("factor") >= F.lit(full)
        row = cells.where(F.col("factor") > 0).agg(
            F.sum(F.when(capped, F.col("tokens"))), F.sum(F.when(~capped, F.col("weight"))), F.min("factor")).first()
        rest = wanted - (row[0] or 0)
        if row[1] is None or rest <= 0:
            return row[2] if row[1] is None and row[2] else full if full < math.inf else 1.0
        if row[1] / rest >= full:
            return full
        full = row[1] / rest


def draw(*parts):
    """Number in [0, 1) from the hash of the given columns."""
    digest = F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(16 ** 12))


def mix(docs: DataFrame, config: RakingConfig = RakingConfig(), topic=None) -> DataFrame:
    """``docs`` with n_tokens, topic, weight of its cell, probability, shortfall of its cell (tokens
    that a capped cell lacks), max_error of the raking, kept."""
    prepare(docs.sparkSession)
    added = ("n_tokens", "topic", "weight", "probability", "shortfall", "max_error", "kept")
    text = text_or_empty()
    rows = (docs.select(*[c for c in docs.columns if c not in added], token_count(text).alias("n_tokens"),
                        (topic_of(text) if topic is None else topic).alias("topic")))
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "raking-tokens")
    raked = rake(cells, config)
    raked = written(raked.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "probability", "shortfall", "max_error"),
                    "raked-cells")
    same = [rows[d].eqNullSafe(raked[f"_{d}"]) for d in DIMENSIONS]
    floor, error = raked.agg(F.min("probability"), F.max("max_error")).first()
    out = rows.join(raked, same[0] & same[1] & same[2], "left")
    probability = F.coalesce("probability", F.lit(float(floor or 0.0)))
    return out.select(*rows.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"), probability.alias("probability"),
                      F.coalesce("shortfall", F.lit(0.0)).alias("shortfall"), F.lit(float(error or 0.0)).alias("max_error"),
                      (draw(F.col("doc_id").cast("string"), F.md5(text_or_empty())) < probability).alias("kept"))


def digest(docs: DataFrame, config: RakingConfig = RakingConfig()) -> DataFrame:
    """Query form: doc_id, source, lang, topic, n_tokens, probability, shortfall, max_error, kept."""
    out = mix(docs.select("doc_id", "text", "source", "lang"), config)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "shortfall", "max_error", "kept")
