"""Training-signal detectors: trailing trends, plateaus, smoothing, readiness.

Series are bounded by the number of epochs of a run, so windows per run or per
(run, batch) stay small; anything along the batch axis is blocked instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import named, ratio

TINY = 1e-8
BATCH_SIGNALS = ("mean_std", "mean_grad_norm")


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(x))


def loss_plateau(epochs: DataFrame, window: int = 5, value: str = "loss",
                 keys: Sequence[str] = ("run",)) -> DataFrame:
    """Relative change of the mean of the last ``window`` losses against the window before.

    0.0 until two windows are filled; 1.0 when the earlier mean is practically zero.
    """
    order = Window.partitionBy(*keys).orderBy("epoch")
    prior = F.avg(value).over(order.rowsBetween(-(2 * window - 1), -window))
    recent = F.avg(value).over(order.rowsBetween(-(window - 1), 0))
    seen = F.row_number().over(order)
    rows = epochs.where(named(value).isNotNull()).select(
        *keys, "epoch", prior.alias("_prior"), recent.alias("_recent"), seen.alias("_seen"))
    change = (F.col("_recent") - F.col("_prior")) / F.col("_prior")
    return rows.select(*keys, "epoch", F.when(F.col("_seen") < 2 * window, 0.0)
                       .when(F.col("_prior") < TINY, 1.0)
                       .otherwise(logistic(-10.0 * change)).alias("signal"))


def validation_trend(epochs: DataFrame, window: int = 5, value: str = "val_acc",
                     keys: Sequence[str] = ("run",)) -> DataFrame:
    """Least-squares slope over the last ``window`` values in units of their deviation (N)."""
    order = Window.partitionBy(*keys).orderBy("epoch")
    rows = epochs.where(named(value).isNotNull()).select(
        *keys, "epoch", named(value).alias("_y"),
        F.row_number().over(order).cast("double").alias("_x"))
    trailing = order.rowsBetween(-(window - 1), 0)
    rows = rows.select(*keys, "epoch", "_x",
                       F.regr_slope(F.col("_y"), F.col("_x")).over(trailing).alias("_slope"),
                       F.stddev_pop("_y").over(trailing).alias("_std"))
    return rows.select(*keys, "epoch", F.when(F.col("_x") < window, 0.0)
                       .when(F.col("_std") < TINY, 1.0)
                       .otherwise(logistic(5.0 * F.col("_slope") / F.col("_std")))
                       .alias("signal"))


def plateaus(series: DataFrame, value: str, window: int = 5,
             keys: Sequence[str] = ("run", "batch_idx")) -> DataFrame:
    """Plateau test after each observation of a series.

    Compares the coefficient of variation of the last ``window`` values with that of all
    values so far: ``stability = max(0, 1 - ratio)``, plateau below a ratio of 0.25. Fewer
    than ``window + 2`` values give 0; a constant series gives 1.
    """
    order = Window.partitionBy(*keys).orderBy("epoch")
    recent = order.rowsBetween(-(window - 1), 0)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    variation = lambda frame: (F.stddev_pop(value).over(frame)
                               / (F.abs(F.avg(value).over(frame)) + TINY))
    rows = series.where(named(value).isNotNull()).select(
        *keys, "epoch", variation(recent).alias("_recent"), variation(so_far).alias("_full"),
        F.row_number().over(order).alias("_seen"))
    share = ratio(F.col("_recent"), F.col("_full"))
    short = F.col("_seen") < window + 2
    return rows.select(
        *keys, "epoch", F.col("_seen").alias("seen"),
        F.when(short, False).when(F.col("_full") < TINY, True)
        .otherwise(share < 0.25).alias("is_plateau"),
        F.when(short, 0.0).when(F.col("_full") < TINY, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - share)).alias("stability"))


def stability_steps(series: DataFrame, values: Sequence[str] = BATCH_SIGNALS,
                    window: int = 5) -> DataFrame:
    """Per (run, epoch) and signal: ``<signal>_step``, the change of the summed stability, and
    ``<signal>_joined``, the number of batches first seen.

    A batch keeps its last score while it is silent, so the sum over all batches only moves by
    the score changes of the batches that reported; nothing has to be carried forward row by
    row. All signals go through one scan and one shuffle by (run, batch, signal).
    """
    keys = ["run", "batch_idx", "signal"]
    pairs = F.array(*[F.struct(F.lit(v).alias("signal"), named(v).cast("double").alias("value"))
                      for v in values])
    long = series.select("run", "epoch", "batch_idx", F.inline(pairs))
    order = Window.partitionBy(*keys).orderBy("epoch")
    before = F.coalesce(F.lag("stability").over(order), F.lit(0.0))
    steps = plateaus(long, "value", window, keys).select(
        "run", "epoch", "signal", (F.col("stability") - before).alias("_step"),
        (F.col("seen") == 1).cast("long").alias("_new"))
    return steps.groupBy("run", "epoch").agg(*[
        F.sum(F.when(F.col("signal") == v, F.col(c))).alias(f"{v}_{n}")
        for v in values for c, n in (("_step", "step"), ("_new", "joined"))])


def mean_stability(value: str) -> Column:
    """Mean over the batches with history, from the steps so far."""
    so_far = (Window.partitionBy("run").orderBy("epoch")
              .rowsBetween(Window.unboundedPreceding, 0))
    return ratio(F.sum(f"{value}_step").over(so_far),
                 F.sum(f"{value}_joined").over(so_far).cast("double"))


def batch_stability(series: DataFrame, value: str, window: int = 5) -> DataFrame:
    """Mean stability over every batch with history, after each epoch with signals."""
    return stability_steps(series, [value], window).select(
        "run", "epoch", mean_stability(value).alias("signal"))


def readiness(epochs: DataFrame, signals: DataFrame, window: int = 5) -> DataFrame:
    """Mean of the four signals after each epoch of ``epochs(run, epoch, loss, val_acc)``."""
    return readiness_of(epochs, stability_steps(signals, window=window), window)


def readiness_of(epochs: DataFrame, steps: DataFrame, window: int = 5) -> DataFrame:
    """Readiness from summed stability steps. A signal keeps its last value while nothing new
    arrives and counts 0.0 before it exists."""
    parts = [epochs.select("run", "epoch", F.lit(True).alias("stepped")),
             loss_plateau(epochs, window).withColumnRenamed("signal", "r_loss"),
             validation_trend(epochs, window).withColumnRenamed("signal", "r_val"),
             steps.select("run", "epoch", *[f"{v}_{n}" for v in BATCH_SIGNALS
                                            for n in ("step", "joined")])]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    table = rows.groupBy("run", "epoch").agg(*[
        F.max(c).alias(c) for c in rows.columns if c not in ("run", "epoch")])
    so_far = (Window.partitionBy("run").orderBy("epoch")
              .rowsBetween(Window.unboundedPreceding, 0))
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    act, grad = (mean_stability(v) for v in BATCH_SIGNALS)
    found = {"r_loss": last("r_loss"), "r_val": last("r_val"), "r_act": act, "r_grad": grad}
    table = table.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in found.items()})
    return table.where("stepped").select(
        "run", "epoch", *found,
        ((F.col("r_loss") + F.col("r_val") + F.col("r_act") + F.col("r_grad")) / 4.0)
        .alias("readiness"))


def smooth_centered(rows: DataFrame, value: str, out: str, half: int, axis: str = "batch_idx",
                    keys: Sequence[str] = ("run", "epoch"), block: int = 4096) -> DataFrame:
    """Mean over ``[i - half, i + half]`` along a dense integer axis, cut at both ends.

    The axis is cut into blocks and each row near a block edge is also sent to its neighbour,
    so a window holds at most ``block + 2 * half`` rows however long the axis is.
    """
    block = max(block, 2 * half + 1)
    placed = rows.withColumn("_block", F.explode(F.sequence(
        F.expr(f"(cast({axis} as long) - {half} + {block}) div {block} - 1"),
        F.expr(f"(cast({axis} as long) + {half}) div {block}"))))
    frame = (Window.partitionBy(*keys, "_block").orderBy(axis).rowsBetween(-half, half))
    return (placed.withColumn(out, F.avg(value).over(frame))
            .where(F.expr(f"cast({axis} as long) div {block} = _block")).drop("_block"))
