"""Batch orders by gradient norm or entropy while a run goes on.

State is keyed by (run, block of batches): a map of running sums, and the reports of epochs that
are still open. An event-time timer at the end of an epoch folds its reports into the sums, so an
epoch closes when the watermark passes its end and needs no summary row. Only means that changed
leave the state; the order of a closed epoch is made from them and a table of the last means, which
is as long as one order and is rewritten when epochs close.

Reports that come before the watermark passes their epoch's end count, in any order; later ones
are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lehrplan.operators.ordering import expand_range
from lehrplan.operators.schedules import order_by_means
from lehrplan.sources.staging import stage
from lehrplan.streaming.pacing import read_parts
from lehrplan.streaming.sessions import ROCKSDB, held

BLOCK = 1024
CHANGES = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()),
                        T.StructField("batch_idx", T.IntegerType()), T.StructField("mean", T.DoubleType())])
MEANS = T.StructType([f for f in CHANGES.fields if f.name != "epoch"])
KEY = T.StructType([T.StructField("batch_idx", T.IntegerType())])
SUM = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
ENDS = T.StructType([T.StructField("ends", T.LongType())])
OPEN = T.StructType([T.StructField("epoch", T.IntegerType()),
                     T.StructField("batches", T.ArrayType(T.IntegerType())),
                     T.StructField("counts", T.ArrayType(T.LongType())),
                     T.StructField("totals", T.ArrayType(T.DoubleType()))])


class RunningMeans(StatefulProcessor):
    """Means of one block of batches of a run; open epochs wait in a map by their end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", KEY, SUM)
        self.open = handle.getMapState("open", ENDS, OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reports = pd.concat(list(rows)).dropna(subset=["batch_idx", "value", "epoch"])
        for (ends, epoch), group in reports.groupby(["ends", "epoch"]):
            own = group.groupby("batch_idx")["value"].agg(["count", "sum"])
            at = (int(ends),)
            if self.open.containsKey(at):
                _, batches, counts, totals = self.open.getValue(at)
                known = pd.DataFrame({"count": counts, "sum": totals}, index=list(batches))
                own = known.add(own, fill_value=0)
            else:
                self.handle.registerTimer(int(ends))
            self.open.updateValue(at, (int(epoch), [int(b) for b in own.index],
                                       [int(n) for n in own["count"]], [float(s) for s in own["sum"]]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        epoch, batches, counts, totals = self.open.getValue(at)
        self.open.removeKey(at)
        means = []
        for batch, n, total in zip(batches, counts, totals):
            if self.sums.containsKey((batch,)):
                before = self.sums.getValue((batch,))
                n, total = n + before[0], total + before[1]
            self.sums.updateValue((batch,), (n, total))
            means.append(total / n)
        yield self.frame(key[0], epoch, batches, means)

    @staticmethod
    def frame(run: str, epoch: int, batches, means) -> pd.DataFrame:
        return pd.DataFrame({"run": np.array([run] * len(batches), object),
                             "epoch": np.full(len(batches), epoch, np.int32),
                             "batch_idx": np.array(batches, np.int32),
                             "mean": np.array(means, np.float64)})

    def close(self) -> None:
        pass


def means_at(last: DataFrame, changes: DataFrame) -> DataFrame:
    """``run, epoch, batch_idx, mean`` of all batches of ``last`` at every epoch in ``changes``:
    a mean holds until the batch's next change."""
    closed = changes.groupBy("run").agg(F.sort_array(F.collect_set("epoch")).alias("_closed"))
    order = Window.partitionBy("run", "batch_idx").orderBy("epoch")
    spans = last.withColumn("epoch", F.lit(-1)).unionByName(changes).withColumns({
        "_next": F.lead("epoch").over(order),
        "_known": F.min("epoch").over(Window.partitionBy("run", "batch_idx"))})
    inside = lambda e: (e >= F.col("epoch")) & (F.col("_next").isNull() | (e < F.col("_next")))
    return spans.where("_known = -1").join(closed, "run").select(
        "run", "batch_idx", "mean", F.explode(F.filter("_closed", inside)).alias("epoch"))


def last_means(spark: SparkSession, path: str, runs: DataFrame, before: int) -> DataFrame:
    """Means after the last micro-batch before ``before`` that closed epochs; 0.0 for all batches
    of runs not met yet."""
    stored = read_parts(spark, f"{path}/last", T.StructType([*MEANS.fields, T.StructField("part", T.LongType())]))
    part = stored.where(F.col("part") < before).agg(F.max("part")).first()[0]
    known = stored.where(F.col("part") == part).drop("part") if part is not None \
        else spark.createDataFrame([], MEANS)
    new = runs.join(known.select("run").distinct(), "run", "left_anti")
    grid = expand_range(new.select("run", "total_batches"), F.col("total_batches"), "batch_idx")
    return known.unionByName(grid.select("run", F.col("batch_idx").cast("int").alias("batch_idx"),
                                         F.lit(0.0).alias("mean")))


def order_stream(telemetry: DataFrame, runs: DataFrame, value: str, ends: Column, path: str,
                 checkpoint: str, delay: str = "0 seconds", smooth_window: int = 5,
                 cold_start_epochs: int = 1, digits: int | None = None, block: int = BLOCK,
                 partitions: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write ``run, epoch, slot, batch_idx`` to ``{path}/orders`` as epochs close.

    ``telemetry`` has ``ts, run, epoch, batch_idx`` and the signal ``value``; ``runs`` holds
    ``run, total_batches``. ``ends`` is the time at which the epoch of a report ends, the same for
    all its reports and later than their ``ts``. An epoch closes when the watermark, the latest
    ``ts`` less ``delay``, has passed its end; rows without ``batch_idx`` only move the watermark.
    Orders are those of `schedules.signal_order` over the same reports, for epochs with reports.
    """
    block_of = F.floor(F.coalesce(F.col("batch_idx"), F.lit(-1)) / F.lit(block)).cast("long")
    keyed = telemetry.withWatermark("ts", delay).select(
        F.coalesce("run", F.lit("")).alias("run"), block_of.alias("block"), "ts",
        F.col("epoch").cast("int").alias("epoch"), F.col("batch_idx").cast("int").alias("batch_idx"),
        F.col(value).cast("double").alias("value"),
        F.unix_millis(ends.cast("timestamp")).alias("ends"))
    changes = keyed.groupBy("run", "block").transformWithStateInPandas(
        RunningMeans(), CHANGES, "Append", "EventTime")

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = stage(batch, "changed-means")
        if new.isEmpty():
            return
        last = last_means(spark, path, runs, batch_id)
        orders = order_by_means(means_at(last, new), smooth_window, cold_start_epochs, digits)
        orders.write.mode("overwrite").parquet(f"{path}/orders/part={batch_id}")
        latest = new.groupBy("run", "batch_idx").agg(F.max_by("mean", "epoch").alias("_new"))
        last.join(latest, ["run", "batch_idx"], "left").select(
            "run", "batch_idx", F.coalesce("_new", "mean").alias("mean")).write.mode(
            "overwrite").parquet(f"{path}/last/part={batch_id}")

    with held(telemetry.sparkSession, ROCKSDB, partitions):
        return (changes.writeStream.outputMode("append").foreachBatch(publish)
                .option("checkpointLocation", checkpoint)
                .trigger(**trigger or {"availableNow": True}).start())
