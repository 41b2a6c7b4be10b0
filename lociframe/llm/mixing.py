"""Mixing sources to target shares by Poisson replication.

The target size is the tokens of all records, or, ``rescaled``, the largest size up to that which all sources can
serve. A source's repetition rate is its share of that size over its own tokens, at most ``max_repeats``. Every
record draws its number of copies by inverting a Poisson distribution at a hash of its id; as draws stop at
``max_repeats``, the Poisson mean is raised until the capped draw has the wanted rate, and then moved to the mean
whose draws come closest to the target (:func:`calibrated`), which a draw at the exact mean misses by chance. A source
that cannot reach its share uses every record ``max_repeats`` times. Copies are then sorted by a hash of (id, copy),
which shuffles them globally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.tokens import TOKENIZER, with_token_counts
from lociframe.session import broadcast_if_small, cut_lineage

GRID = 2049
WIDTH = 0.7
_RATES = "source string, target_share double, max_repeats int, tokens bigint, goal double, rate double, mean double"


def poisson_cdf(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k < ``cap``; a draw is the number of entries that are at most u.

    An infinite mean gives zeros, so every draw is ``cap``; a mean of 0 gives no entry, so none is made.
    """
    if math.isinf(mean):
        return [0.0] * cap
    out, total, log_term = [], 0.0, -mean
    for k in range(cap if mean > 0 else 0):
        total += math.exp(log_term)
        out.append(min(total, 1.0))
        log_term += math.log(mean) - math.log(k + 1)
        if total >= 1 - 1e-15 and k > mean:
            break
    return out


def capped_mean(rate: float, cap: int) -> float:
    """The Poisson mean at which min(X, cap) averages ``rate``."""
    if rate >= cap or rate <= 0:
        return math.inf if rate > 0 else 0.0
    low, high = rate, max(2 * rate, 1.0)
    while sum(1 - p for p in poisson_cdf(high, cap)) < rate and high < 1e6:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(1 - p for p in poisson_cdf(mid, cap)) < rate else (low, mid)
    return high


def source_rates(counted: DataFrame, targets: DataFrame, rescaled: bool = False) -> DataFrame:
    """Per source of ``targets``: tokens, the tokens it should give (``goal``), repetition rate and the Poisson
    ``mean``. Sources without records have 0 tokens; records of sources without a target count in the
    total only."""
    per_source = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    goals = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = goals.join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = float(per_source.agg(F.sum("tokens")).first()[0] or 0)
    if rescaled:
        most = joined.filter("target_share > 0").agg(F.min(F.expr("max_repeats * tokens / target_share"))).first()[0]
        total = min(total, most or 0.0)
    joined = joined.withColumn("goal", F.col("target_share") * F.lit(total)).withColumn("rate", F.expr("if(tokens = 0, 0D, least(cast(max_repeats as double), goal / tokens))"))

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(mean=[capped_mean(r, int(c)) for r, c in zip(part.rate, part.max_repeats)])

    return joined.select("source", "target_share", "max_repeats", "tokens", "goal", "rate").mapInPandas(means, _RATES)


def _draw(seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / F.lit(float(2**53))).alias("u")


def mean_grid(mean: float) -> np.ndarray:
    return mean * np.exp(WIDTH * np.linspace(-1, 1, GRID))


def copies_on_grid(mean: float, cap: int) -> np.ndarray:
    """P(X < j) for j = 1 .. cap (rows) at each mean of the grid (columns, falling)."""
    grid = mean_grid(mean)
    term = np.exp(-grid)
    out = [term.copy()]
    for j in range(1, cap):
        term = term * grid / j
        out.append(out[-1] + term)
    return np.minimum(np.array(out), 1.0)


def calibrated(counted: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """``rates`` with each mean moved to the point of a grid whose draws come closest to the goal.

    A record has its j-th copy from a certain mean on, as P(X < j) falls with the mean; one pass adds up the
    tokens that begin at each point of the grid, and their running total is what is drawn there. At most
    ``GRID`` rows a source are shuffled by each task.
    """

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple[float, int], np.ndarray] = {}
        for part in batches:
            for (source, mean, cap), own in part.groupby(["source", "mean", "max_repeats"]):
                if not 0 < mean < math.inf:
                    continue
                if (mean, cap) not in tables:
                    tables[mean, cap] = copies_on_grid(mean, int(cap))
                u, n, added = own.u.to_numpy(), own.n_tokens.to_numpy(), np.zeros(GRID + 1, dtype=np.int64)
                for below in tables[mean, cap]:
                    np.add.at(added, np.searchsorted(-below, -u, side="left"), n)  # first mean with P(X < j) <= u
                at = np.flatnonzero(added[:GRID])
                yield pd.DataFrame({"source": source, "at": at, "n": added[at]})

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            best = []
            for mean, at, n, goal in zip(part["mean"], part["at"], part["n"], part.goal):
                if at is None:
                    best.append(mean)
                    continue
                drawn = np.cumsum(np.bincount(np.asarray(at), weights=np.asarray(n, dtype=float), minlength=GRID))
                miss = np.abs(drawn - goal)
                best.append(float(mean_grid(mean)[min(np.flatnonzero(miss == miss.min()), key=lambda j: abs(j - GRID // 2))]))
            yield part.assign(mean=best).drop(columns=["at", "n"])

    drawn = (
        counted.join(broadcast_if_small(rates.select("source", "mean", "max_repeats"), 10_000), "source")
        .select("source", "mean", "max_repeats", "n_tokens", _draw(seed))
        .mapInPandas(begins, "source string, at int, n bigint")
        .groupBy("source", "at").agg(F.sum("n").alias("n"))
        .groupBy("source").agg(F.collect_list(F.struct("at", "n")).alias("x"))
        .select("source", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    )
    return rates.join(drawn, "source", "left").mapInPandas(nearest, _RATES)


def mix_sources(df: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER, shuffled: bool = True, rescaled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: ``mix_key`` (its order), ``doc_id``, ``source``, ``copy_no`` from 1, ``n_tokens``; texts come
    by a join on doc_id. Report, one row per source of ``targets`` (``source``, ``target_share``,
    ``max_repeats``): ``tokens``, ``goal`` (tokens it should give), ``rate``, ``mixed_tokens``, ``most_used``,
    ``reachable``, ``actual_share`` (of the mixture) and ``share_of_goal`` (of the target size, to which the targets
    refer). A source that gave all its records ``max_repeats`` times and still misses its goal is not
    ``reachable``. While some source is not, the mixture is smaller than the target size and the others have more
    than their share of it; ``rescaled`` lowers the target size so that all shares hold in the mixture too.

    Null and empty texts have no tokens but are replicated like others; a null source has no target and is
    not mixed; records that repeat an id draw the same number. An empty corpus gives a report of zeros and
    null shares.
    """
    counted = cut_lineage(with_token_counts(df, "text", ["doc_id", "source"], tokenizer))
    rates = cut_lineage(source_rates(counted, targets, rescaled))
    rates = cut_lineage(calibrated(counted, rates, seed))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"source": part.source, "cdf": [poisson_cdf(m, int(c)) for m, c in zip(part["mean"], part.max_repeats)]})

    tables = rates.select("source", "mean", "max_repeats").mapInPandas(table, "source string, cdf array<double>")
    copies = (
        counted.join(broadcast_if_small(tables, 10_000), "source")
        .select("doc_id", "source", "n_tokens", "cdf", _draw(seed))
        .withColumn("n", F.expr("size(filter(cdf, p -> u >= p))"))
        .filter("n > 0")
        .select("doc_id", "source", "n_tokens", "n")
    )
    mixed = copies.select("*", F.explode(F.expr("sequence(1, n)")).alias("copy_no")).select(
        F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)).alias("mix_key"), "doc_id", "source", "copy_no", "n_tokens"
    )
    used = copies.groupBy("source").agg(F.sum(F.expr("n * n_tokens")).alias("mixed_tokens"), F.max("n").alias("most_used"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a source
    report = (
        rates.drop("mean").join(used, "source", "left")
        .withColumns({"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "most_used": F.coalesce("most_used", F.lit(0))})
        .withColumn("reachable", F.expr("not (mixed_tokens = max_repeats * tokens and mixed_tokens < goal)"))
        .withColumns({"actual_share": F.try_divide(F.col("mixed_tokens"), whole), "share_of_goal": F.expr("try_divide(mixed_tokens * target_share, goal)")})
    )
    return mixed.orderBy("mix_key", "doc_id", "copy_no") if shuffled else mixed, report
