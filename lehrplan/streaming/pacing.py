"""Adaptive pacing over a stream of telemetry.

Stability is tracked per (run, batch), so a run with many batches is spread over all tasks.
Each report yields the change of its batch's score; changes are summed per (run, epoch) before
anything is brought together, and the pacing recurrence runs over that small table.

A report that arrives after its epoch has closed counts from the next epoch on. A report older
than the last one of its own batch is dropped and counted as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lehrplan.operators.schedules import pace
from lehrplan.operators.signals import BATCH_SIGNALS as SIGNALS, TINY, readiness_of
from lehrplan.streaming.sessions import ROCKSDB, held

TELEMETRY = ("run string, epoch int, batch_idx int, mean_std double, mean_grad_norm double, "
             "loss double, val_acc double")
STEPS = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()),
    *[T.StructField(f"{s}_{k}", T.DoubleType()) for s in SIGNALS for k in ("step", "joined")],
    T.StructField("loss", T.DoubleType()), T.StructField("val_acc", T.DoubleType()),
    T.StructField("closes", T.BooleanType()), T.StructField("late", T.LongType())])
MEMORY = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    *[f for s in SIGNALS for f in (
        T.StructField(f"{s}_n", T.LongType()), T.StructField(f"{s}_mean", T.DoubleType()),
        T.StructField(f"{s}_m2", T.DoubleType()), T.StructField(f"{s}_score", T.DoubleType()),
        T.StructField(f"{s}_recent", T.ArrayType(T.DoubleType())))]])


class BatchStability(StatefulProcessor):
    """Plateau score of one batch's signals: running moments plus the last ``window`` values."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", MEMORY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, batch = key
        reports = pd.concat(list(rows)).sort_values("epoch", kind="stable")
        if batch < 0:  # epoch summaries pass through
            yield self.frame([{"run": run, "epoch": int(r.epoch), "loss": r.loss,
                               "val_acc": r.val_acc, "closes": True, "late": 0}
                              for r in reports.itertuples()])
            return
        state = self.memory.get() if self.memory.exists() else None
        series = {s: self.restore(state, i) for i, s in enumerate(SIGNALS)}
        last = state[0] if state else -1
        out = []
        for r in reports.itertuples():
            row = {"run": run, "epoch": int(r.epoch), "closes": False, "late": 0}
            if r.epoch <= last:
                out.append({**row, "late": 1})
                continue
            last = int(r.epoch)
            for s in SIGNALS:
                value = getattr(r, s)
                if not pd.isna(value):
                    row[f"{s}_joined"] = float(series[s]["n"] == 0)
                    row[f"{s}_step"] = self.observe(series[s], float(value))
            out.append(row)
        self.memory.update((last, *[v for s in SIGNALS for v in (
            series[s]["n"], series[s]["mean"], series[s]["m2"], series[s]["score"],
            series[s]["recent"])]))
        yield self.frame(out)

    def restore(self, state, i: int) -> dict:
        if state is None:
            return {"n": 0, "mean": 0.0, "m2": 0.0, "score": 0.0, "recent": []}
        return dict(zip(("n", "mean", "m2", "score", "recent"), state[1 + 5 * i:6 + 5 * i])) | {
            "recent": list(state[5 + 5 * i])}

    def observe(self, s: dict, value: float) -> float:
        """Fold one value in; the change of the stability score."""
        s["n"] += 1
        shift = value - s["mean"]
        s["mean"] += shift / s["n"]
        s["m2"] += shift * (value - s["mean"])
        s["recent"] = [*s["recent"], value][-self.window:]
        before = s["score"]
        if s["n"] >= self.window + 2:
            recent = np.std(s["recent"]) / (abs(np.mean(s["recent"])) + TINY)
            full = np.sqrt(s["m2"] / s["n"]) / (abs(s["mean"]) + TINY)
            s["score"] = 1.0 if full < TINY else max(0.0, 1.0 - float(recent / full))
        return s["score"] - before

    @staticmethod
    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=STEPS.names)

    def close(self) -> None:
        pass


def read_parts(spark, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_readiness(steps: DataFrame, window: int) -> DataFrame:
    """Readiness of the closed epochs from all parts of the steps table."""
    totals = steps.groupBy("run", "epoch").agg(
        *[F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in SIGNALS for k in ("step", "joined")],
        F.max("loss").alias("loss"), F.max("val_acc").alias("val_acc"),
        F.max("closes").alias("closes"))
    return readiness_of(totals.where("closes"), totals, window)


def pacing_stream(telemetry: DataFrame, runs: DataFrame, total_epochs: int, path: str,
                  checkpoint: str, start_fraction: float = 0.3, window: int = 5,
                  partitions: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Emit ``run, epoch, n_active`` to ``{path}/orders`` as epochs close.

    ``telemetry`` has the `TELEMETRY` columns: batch reports, and one summary per epoch with
    ``batch_idx`` missing, which closes the epoch. ``{path}/steps`` holds the summed steps and
    the count of late reports. ``partitions`` sets the number of state partitions, which stays
    for the life of the checkpoint. ``trigger`` holds the arguments of
    ``DataStreamWriter.trigger``; by default the stream ends when all that is there has been read.
    """
    keyed = telemetry.withColumn("batch_idx", F.coalesce("batch_idx", F.lit(-1)))
    steps = keyed.groupBy("run", "batch_idx").transformWithStateInPandas(
        BatchStability(window), STEPS, "Append", "None")

    def close_epochs(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = read_parts(spark, f"{path}/steps", T.StructType(
            [*STEPS.fields, T.StructField("part", T.LongType())])).where(
                F.col("part") < batch_id).drop("part")
        closed = known.where("closes").groupBy("run").agg(F.max("epoch").alias("_closed"))
        summed = batch.groupBy("run", "epoch").agg(
            *[F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in SIGNALS
              for k in ("step", "joined")],
            F.max("loss").alias("loss"), F.max("val_acc").alias("val_acc"),
            F.max("closes").alias("closes"), F.sum("late").alias("late"))
        placed = summed.join(closed, "run", "left").withColumn(
            "epoch", F.greatest("epoch", F.coalesce(F.col("_closed") + 1, F.col("epoch"))))
        placed.drop("_closed").write.mode("overwrite").parquet(f"{path}/steps/part={batch_id}")
        part = spark.read.schema(STEPS).parquet(f"{path}/steps/part={batch_id}")
        ready = stream_readiness(known.unionByName(part), window)
        counts = pace(runs, ready, total_epochs, start_fraction)
        (counts.join(part.where("closes").select("run", "epoch"), ["run", "epoch"], "left_semi")
         .write.mode("overwrite").parquet(f"{path}/orders/part={batch_id}"))

    with held(telemetry.sparkSession, ROCKSDB, partitions):  # this kind of state needs RocksDB
        return (steps.writeStream.outputMode("append").foreachBatch(close_epochs)
                .option("checkpointLocation", checkpoint)
                .trigger(**trigger or {"availableNow": True}).start())
