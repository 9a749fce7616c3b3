"""Quantiles of a score stream from mergeable sketches.

A KLL sketch per metric and scope is the state of a streaming aggregation: it holds a few thousand
values however long the stream is, is combined before the shuffle, and sketches of several streams
or parts merge into one of the same bound. Extremes and counts are exact.

``RANK_ERROR`` bounds how far the rank of an estimated quantile lies from the wanted one, as a share
of all values. At ``K`` the sketch misses it with a probability below one in a million (its own bound
at 99 % is 0.3 %).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lehrplan.operators.distributions import QUANTILES, melt
from lehrplan.streaming.distributions import latest_distributions, scopes

K = 1024
RANK_ERROR = 0.01


def quantile_sketches(scores: DataFrame, metrics: Sequence[str], label: str = "class",
                      k: int = K) -> DataFrame:
    """``metric, scope, sketch`` of a table or a stream; missing scores are skipped."""
    values = melt(scores, metrics, label=label).where("value is not null")
    return values.select("metric", scopes().alias("scope"), "value").groupBy("metric", "scope").agg(
        F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged_sketches(*tables: DataFrame, k: int = K) -> DataFrame:
    """One sketch per metric and scope from those of several tables."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy("metric", "scope").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """``metric, scope, count`` and one column per quantile, each a value of the stream."""
    return sketches.select("metric", "scope", F.kll_sketch_get_n_double("sketch").alias("count"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(n)
        for n, q in (quantiles or QUANTILES).items()])


def within(below: Column, upto: Column, count: Column, quantile: float, error: float = RANK_ERROR) -> Column:
    """Whether a value with ``below`` smaller and ``upto`` smaller or equal ones out of ``count`` is
    a ``quantile`` within ``error``."""
    return (below <= (quantile + error) * count) & (upto >= (quantile - error) * count)


def quantile_stream(scores: DataFrame, metrics: Sequence[str], path: str, checkpoint: str, k: int = K,
                    trigger: dict | None = None) -> StreamingQuery:
    """Add the sketches after each micro-batch as a part of their own below ``path``;
    `latest_sketches` reads the last. ``trigger`` as in `distribution_stream`."""
    def publish(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    return (quantile_sketches(scores, metrics, k=k).writeStream.outputMode("complete")
            .foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(**trigger or {"availableNow": True}).start())


def latest_sketches(spark: SparkSession, path: str) -> DataFrame:
    return latest_distributions(spark, path)
