"""Column-wise scaling of score tables and correlations with an anchor metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lehrplan.functions.columns import (correlation, correlation_parts, named, present,
                                        ratio, with_statistics)
from lehrplan.operators.ranks import FLAT, extremes, zscore_statistics


def _scores(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return scores.select("index", *[present(named(m)).alias(m) for m in metrics])


def rescale(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Min-max scaled metrics; a constant column becomes 0."""
    table = with_statistics(_scores(scores, metrics), extremes(metrics))
    return table.select("index", *[
        F.when(F.col(f"_hi{i}") - F.col(f"_lo{i}") < FLAT, F.lit(0.0)).otherwise(
            ratio(named(m) - F.col(f"_lo{i}"), F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(m)
        for i, m in enumerate(metrics)])


def standardize(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """z-scores with the N-1 deviation; a constant column becomes missing."""
    table = with_statistics(_scores(scores, metrics), zscore_statistics(metrics))
    return table.select("index", *[
        ratio(named(m) - F.col(f"_avg{i}"), F.col(f"_std{i}")).alias(m)
        for i, m in enumerate(metrics)])


def anchor_correlations(scores: DataFrame, anchor: str, metrics: Sequence[str]) -> DataFrame:
    """``metric, correlation`` with the anchor; missing for constant columns."""
    others = [m for m in metrics if m != anchor]
    row = _scores(scores, [anchor, *others]).agg(
        *[correlation(*correlation_parts(named(m), named(anchor))).alias(m) for m in others])
    return row.unpivot([], [named(m) for m in others], "metric", "correlation")


def column_statistics(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``metric, mean, minimum, maximum, range, constant`` in one pass."""
    row = _scores(scores, metrics).agg(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.avg(named(m)).alias("mean"),
        F.min(named(m)).alias("minimum"), F.max(named(m)).alias("maximum")) for m in metrics])
        .alias("s"))
    span = F.col("maximum") - F.col("minimum")
    return row.select(F.inline("s")).withColumns({"range": span, "constant": span < FLAT})
