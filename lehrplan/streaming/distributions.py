"""Running distribution statistics of a score stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lehrplan.operators.distributions import GLOBAL, melt, moments


def scopes() -> Column:
    """A value counts for the whole table and for its class."""
    return F.explode(F.when(F.col("class").isNull(), F.array(F.lit(GLOBAL))).otherwise(
        F.array(F.lit(GLOBAL), F.col("class"))))


def running_distributions(scores: DataFrame, metrics: Sequence[str], label: str = "class"
                          ) -> DataFrame:
    """Count, mean, extremes and deviation per metric and scope. Exact quantiles need all values
    and exist only in the batch form; `quantiles` has bounded ones."""
    return (melt(scores, metrics, label=label).select("metric", scopes().alias("scope"), "value")
            .groupBy("metric", "scope").agg(*moments()))


def distribution_stream(scores: DataFrame, metrics: Sequence[str], path: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Add the statistics after each micro-batch as a part of their own below ``path``, so
    readers of earlier ones are not disturbed; `latest_distributions` reads the last.

    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; by default the stream ends
    when all that is there has been read.
    """
    def publish(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    return (running_distributions(scores, metrics).writeStream.outputMode("complete")
            .foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(**trigger or {"availableNow": True}).start())


def latest_distributions(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of the last micro-batch (one row per metric and scope)."""
    parts = spark.read.parquet(path)
    last = parts.agg(F.max("part")).first()[0]
    return parts.where(F.col("part") == last).drop("part")
