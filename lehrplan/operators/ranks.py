"""Ranks: from a score table to ``(index, position)``.

A scheme is a function ``(scores, metrics, groups, inverted) -> (scores with key columns, sort
columns)``. Everything else (missing values last, ties by index, global or per-batch
positions) is shared by `rank`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import (Groups, correlation, correlation_parts, named,
                                        numeric_columns, present, ratio, with_statistics)
from lehrplan.operators.ordering import positions
from lehrplan.operators.voting import BLOCK, pair_votes, sequential_weights
from lehrplan.registry import METRICS, RANKS

FLAT = 1e-10  # a column whose range is below this counts as constant


def rank(scores: DataFrame, scheme: str, metrics: str | Sequence[str], *,
         partition_by: str | None = None, bounded: bool = False, index: str = "index",
         inverted: Sequence[str] | None = None, digits: int | None = None,
         row_order: str | None = None) -> DataFrame:
    """Order samples by a registered scheme.

    Returns ``[partition_by,] index, position``. With ``partition_by`` every group is ranked
    on its own statistics; say ``bounded`` if each group fits in a task (a batch), which saves
    the sort of the whole table. ``inverted`` names metrics where
    high means easy and defaults to the registry's tag. ``digits`` rounds composite keys, for
    comparisons between engines that add floats in different orders.
    """
    entry = RANKS.get(scheme)
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    if not metrics:
        raise ValueError(f"{scheme}: at least one metric is needed")
    if "single" in entry.tags and len(metrics) > 1:
        raise ValueError(f"{scheme} takes exactly one metric, got {metrics}")
    missing = [m for m in metrics if m not in scores.columns]
    if missing:
        raise KeyError(f"score table lacks {missing}")
    if inverted is None:
        inverted = METRICS.ids(["inverted"])

    columns = numeric_columns(scores) if "all-columns" in entry.tags else metrics
    columns = list(dict.fromkeys([*metrics, *[c for c in columns
                                              if c not in (index, partition_by, row_order)]]))
    group = [partition_by] if partition_by else []
    extra = [row_order] if row_order and row_order not in (index, *group) else []
    base = scores.select(*[named(g) for g in group], named(index), *[named(e) for e in extra],
                         *[present(named(c)).alias(c) for c in columns])
    if "per-batch" in entry.tags:
        if not partition_by:  # the whole table is one batch
            return sequential_vote(base, metrics, index, row_order or index,
                                   [m for m in metrics if m in inverted], digits)
        if not bounded:
            raise ValueError(f"{scheme} votes row by row: give bounded groups, rank the whole table, "
                             "or use 'correlation-sum'")
        return entry.build(base, metrics, partition_by, index, row_order or index,
                           [m for m in metrics if m in inverted])

    keyed, order = entry.build(base, columns if "all-columns" in entry.tags else metrics,
                               Groups(partition_by, bounded, row_order or index) if partition_by else None,
                               [m for m in metrics if m in inverted])
    if digits is not None and "composite-key" in entry.tags:
        keyed = keyed.withColumn("_key", F.round("_key", digits))
    order = [*order, named(index).asc()]
    if not (partition_by and bounded):
        return positions(keyed, order, keep=[index], by=group, label=f"rank-{scheme}")
    window = Window.partitionBy(named(partition_by)).orderBy(*order)
    return keyed.select(named(partition_by), named(index),
                        (F.row_number().over(window) - 1).cast("long").alias("position"))


def rank_key(scores: DataFrame, scheme: str, metrics: Sequence[str], *,
             inverted: Sequence[str] = (), index: str = "index") -> DataFrame:
    """``index, key``: the composite value a scheme sorts by (for inspection)."""
    entry = RANKS.get(scheme)
    columns = numeric_columns(scores) if "all-columns" in entry.tags else list(metrics)
    columns = list(dict.fromkeys([*metrics, *[c for c in columns if c != index]]))
    base = scores.select(named(index), *[present(named(c)).alias(c) for c in columns])
    keyed, _ = entry.build(base, columns, None, list(inverted))
    return keyed.select(named(index), F.col("_key").alias("key"))


# Monotonic and deviation schemes ----------------------------------------------------------

@RANKS.register("ascending", tags=["monotonic", "single"])
def ascending(scores, metrics, groups, inverted):
    return scores, [named(metrics[0]).asc_nulls_last()]


@RANKS.register("descending", tags=["monotonic", "single"])
def descending(scores, metrics, groups, inverted):
    return scores, [named(metrics[0]).desc_nulls_last()]


@RANKS.register("distance-from-mean",
                tags=["deviation", "distance-based", "single", "composite-key"])
def distance_from_mean(scores, metrics, groups, inverted):
    x = named(metrics[0])
    keyed = with_statistics(scores, {"_mean": F.avg(x)}, groups)
    return (keyed.withColumn("_key", F.abs(x - F.col("_mean"))),
            [F.col("_key").asc_nulls_last()])


# Composite schemes ------------------------------------------------------------------------

@RANKS.register("lexicographic", tags=["composite"])
def lexicographic(scores, metrics, groups, inverted):
    return scores, [named(m).asc_nulls_last() for m in metrics]


def mean_of_present(values: Sequence[Column]) -> Column:
    """Row mean that skips NULLs; NULL when all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return ratio(total, count.cast("double"))


def extremes(metrics: Sequence[str]) -> dict[str, Column]:
    return {f"_{side}{i}": fn(named(m)) for i, m in enumerate(metrics)
            for side, fn in (("lo", F.min), ("hi", F.max))}


@RANKS.register("normalized-mean", tags=["composite", "composite-key"])
def normalized_mean(scores, metrics, groups, inverted):
    keyed = with_statistics(scores, extremes(metrics), groups)
    scaled = []
    for i, m in enumerate(metrics):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        value = F.when(span < FLAT, F.lit(0.0)).otherwise(
            ratio(named(m) - F.col(f"_lo{i}"), span))
        scaled.append(1.0 - value if m in inverted else value)
    return (keyed.withColumn("_key", mean_of_present(scaled)),
            [F.col("_key").asc_nulls_last()])


def zscore_statistics(columns: Sequence[str]) -> dict[str, Column]:
    stats = {}
    for i, c in enumerate(columns):
        stats[f"_avg{i}"] = F.avg(named(c))
        stats[f"_std{i}"] = F.stddev_samp(named(c))
    return stats


@RANKS.register("weighted", tags=["composite", "composite-key", "single", "all-columns"])
def weighted(scores, columns, groups, inverted):
    """Anchor z-score plus the other z-scores weighted by |correlation with the anchor|."""
    anchor, others = columns[0], range(1, len(columns))
    stats = zscore_statistics(columns)
    for i in others:
        parts = correlation_parts(named(columns[i]), named(anchor))
        stats |= {f"_{p}{i}": a for p, a in zip(("cov", "sx", "sy"), parts)}
    keyed = with_statistics(scores, stats, groups)
    keyed = keyed.withColumns({f"_r{i}": correlation(*[F.col(f"_{p}{i}") for p in
                                                       ("cov", "sx", "sy")]) for i in others})
    z = [ratio(named(c) - F.col(f"_avg{i}"), F.col(f"_std{i}")) for i, c in enumerate(columns)]
    key = z[0]
    if others:
        strength = reduce(lambda a, b: a + b,
                          [F.coalesce(F.abs(F.col(f"_r{i}")), F.lit(0.0)) for i in others])
        terms = [F.coalesce(ratio(F.abs(F.col(f"_r{i}")), strength) * z[i], F.lit(0.0))
                 for i in others]
        key = key + reduce(lambda a, b: a + b, terms)
    return keyed.withColumn("_key", key), [F.col("_key").asc_nulls_last()]


# Correlation votes ------------------------------------------------------------------------

def unit_rows(scores: DataFrame, metrics: Sequence[str], groups: Groups | None,
              inverted: Sequence[str]) -> DataFrame:
    """Add ``_x`` = the min-max scaled metric vector of a row, centred and L2-normalised.

    Rows with a missing metric get NULL: their correlation with anything counts as zero.
    """
    if len(metrics) < 2:
        raise ValueError("correlating rows needs at least two metrics")
    keyed = with_statistics(scores, extremes(metrics), groups)
    scaled = []
    for i, m in enumerate(metrics):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        span = F.when(span < FLAT, F.lit(1.0)).otherwise(span)
        value = (named(m) - F.col(f"_lo{i}")) / span
        scaled.append(1.0 - value if m in inverted else value)
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    keyed = keyed.withColumns({f"_s{i}": v for i, v in enumerate(scaled)})
    scaled = [F.col(f"_s{i}") for i in range(len(metrics))]
    keyed = keyed.withColumn("_row_mean", add(scaled) / float(len(metrics)))
    keyed = keyed.withColumns({f"_c{i}": v - F.col("_row_mean") for i, v in enumerate(scaled)})
    centred = [F.col(f"_c{i}") for i in range(len(metrics))]
    norm = F.sqrt(add([c * c for c in centred]))
    keyed = keyed.withColumn("_norm", F.when(norm < FLAT, F.lit(1.0)).otherwise(norm))
    return keyed.withColumns({f"_x{i}": c / F.col("_norm") for i, c in enumerate(centred)})


@RANKS.register("correlation-sum", tags=["composite", "composite-key"])
def correlation_sum(scores, metrics, groups, inverted):
    """Order-free vote: the sum of a row's correlations with every other row.

    ``sum_j x_i.x_j = x_i.(sum_j x_j) - x_i.x_i``, so one aggregate of K numbers replaces all
    pairs. Equals the sequential vote while weights and correlations stay non-negative.
    """
    keyed = unit_rows(scores, metrics, groups, inverted)
    xs = [F.col(f"_x{i}") for i in range(len(metrics))]
    keyed = with_statistics(keyed, {f"_t{i}": F.sum(x) for i, x in enumerate(xs)}, groups)
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    vote = add([x * F.col(f"_t{i}") for i, x in enumerate(xs)]) - add([x * x for x in xs])
    return (keyed.withColumn("_key", F.coalesce(vote, F.lit(0.0))),
            [F.col("_key").asc_nulls_last()])


def unit_rows_of(values: np.ndarray, inverted: Sequence[int]) -> np.ndarray:
    """Numpy form of `unit_rows` for stacked batches (batch, row, metric); NaN rows stay NaN."""
    have = ~np.isnan(values)
    some = have.any(axis=1, keepdims=True)
    low = np.where(some, np.where(have, values, np.inf).min(axis=1, keepdims=True), 0.0)
    high = np.where(some, np.where(have, values, -np.inf).max(axis=1, keepdims=True), 0.0)
    scaled = (values - low) / np.where(high - low < FLAT, 1.0, high - low)
    for k in inverted:
        scaled[..., k] = 1.0 - scaled[..., k]
    # metric by metric, as `unit_rows` adds: other orders differ in the last bits, which decide votes
    add = lambda x: reduce(np.add, [x[..., k, None] for k in range(x.shape[-1])])
    centred = scaled - add(scaled) / scaled.shape[-1]
    norm = np.sqrt(add(centred * centred))
    return centred / np.where(norm < FLAT, 1.0, norm)


def sequential_votes(x: np.ndarray) -> np.ndarray:
    """Weights of every row after all pairs i<j of its batch have voted, in row order.

    A pair pushes both weights by its correlation; the directions depend on the weights at that
    moment, so pairs go one after the other, but all stacked batches take each step together.
    Opposite signs meet in the middle, agreement strengthens the shared sign, disagreement drives
    the pair apart. Missing and padding rows correlate with nothing (0 changes no weight).
    """
    batches, size, metrics = x.shape
    x = np.ascontiguousarray(x.transpose(2, 1, 0))
    weights = np.zeros((size, batches))
    for i in range(size - 1):
        similar = np.nan_to_num(reduce(np.add, [x[k, i] * x[k, i + 1:] for k in range(metrics)]), nan=0.0)
        own = weights[i]
        for j in range(i + 1, size):
            own, weights[j] = pair_votes(own, weights[j], similar[j - i - 1])
        weights[i] = own
    return weights.T


VOTE_ROWS = 1 << 16  # rows voting together; bounds the memory of a stack


def vote_frame(rows: pd.DataFrame, batch: str, index: str, metrics: Sequence[str],
               flips: Sequence[int]) -> pd.DataFrame:
    """Positions inside each batch of ``rows`` (complete batches, in row order)."""
    number = (rows[batch] != rows[batch].shift()).cumsum().to_numpy() - 1
    size = np.bincount(number)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    stack = np.full((len(size), size.max(), len(metrics)), np.nan)
    stack[number, place] = rows[metrics].to_numpy(dtype=float)
    weights = sequential_votes(unit_rows_of(stack, flips))
    out = pd.DataFrame({batch: rows[batch].to_numpy(), index: rows[index].to_numpy(),
                        "_b": number, "_w": weights[number, place]})
    out = out.sort_values(["_b", "_w", index], kind="stable")
    return out[[batch, index]].assign(position=place)


@RANKS.register("pairwise-correlation", tags=["composite", "per-batch"])
def pairwise_correlation(scores, metrics, partition_by, index, row_order, inverted):
    """Sequential vote inside each batch; batches run in parallel and are bounded in size."""
    if len(metrics) < 2:
        raise ValueError("pairwise-correlation needs at least two metrics")
    flips, stack_rows = [metrics.index(m) for m in inverted], VOTE_ROWS
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            done = (held[partition_by] != held[partition_by].iloc[-1]).to_numpy()
            if done.sum() >= stack_rows:  # the last batch may go on in the next frame
                yield vote_frame(held[done], partition_by, index, metrics, flips)
                held = held[~done]
        if held is not None and len(held):
            yield vote_frame(held, partition_by, index, metrics, flips)

    placed = scores.repartition(named(partition_by)).sortWithinPartitions(
        named(partition_by), named(row_order), named(index))
    return placed.mapInPandas(
        vote, f"`{partition_by}` {kinds[partition_by]}, `{index}` {kinds[index]}, position long")


def sequential_vote(scores: DataFrame, metrics: Sequence[str], index: str = "index",
                    row_order: str = "index", inverted: Sequence[str] = (),
                    digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """``index, position`` by the sequential vote of all rows, blocks of them in parallel. All pairs
    vote: for tables too large for quadratic work there is `correlation_sum`."""
    unit = unit_rows(scores, metrics, None, inverted)
    weights = sequential_weights(unit, [f"_x{i}" for i in range(len(metrics))], index, row_order, block)
    key = F.col("weight") if digits is None else F.round("weight", digits)
    return positions(weights.withColumn("_key", key), [F.col("_key").asc(), named(index).asc()],
                     keep=[index], label="rank-vote")
