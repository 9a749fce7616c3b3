"""Pacing schedules, for any number of runs at once.

``runs`` holds ``run, total_batches``. Prefix schedules return ``run, epoch, n_active``
(batches 0..n_active-1 in order); ordering schedules return ``run, epoch, slot, batch_idx``.
The order computed after epoch e is what epoch e+1 exposes (see `exposure`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import ratio
from lehrplan.operators.ordering import expand_range, positions
from lehrplan.operators.signals import readiness, smooth_centered
from lehrplan.registry import SCHEDULES


def total_batches(samples: Column, batch_size: int) -> Column:
    return F.ceil(samples / float(batch_size)).cast("int")


def check_fraction(start_fraction: float) -> None:
    if not 0.0 < start_fraction < 1.0:
        raise ValueError(f"start_fraction must lie in (0, 1), got {start_fraction}")


def schedule(id: str, runs: DataFrame, total_epochs: int, **inputs) -> DataFrame:
    """Run a registered schedule and return its batch orders, prefix or not."""
    entry = SCHEDULES.get(id)
    result = entry.build(runs, total_epochs, **inputs)
    return prefix_order(result) if "prefix" in entry.tags else result


def prefix_order(counts: DataFrame) -> DataFrame:
    """Batch ids 0..n_active-1 of each (run, epoch) as slots."""
    return expand_range(counts.select("run", "epoch", "n_active"), F.col("n_active"), "slot") \
        .select("run", "epoch", F.col("slot").cast("int").alias("slot"),
                F.col("slot").cast("int").alias("batch_idx"))


@SCHEDULES.register("linear", tags=["pacing", "fixed", "prefix"])
def linear(runs: DataFrame, total_epochs: int, start_fraction: float = 0.3,
           full_data_epoch: int | None = None, **_) -> DataFrame:
    """Share of batches grows linearly until ``full_data_epoch`` (default 60% of epochs)."""
    check_fraction(start_fraction)
    full = max(1, int(0.6 * total_epochs)) if full_data_epoch is None else full_data_epoch
    if not 1 <= full <= total_epochs:
        raise ValueError(f"full_data_epoch must lie in [1, {total_epochs}], got {full}")
    rows = runs.select("run", "total_batches", F.explode(
        F.sequence(F.lit(1), F.lit(total_epochs))).alias("epoch"))
    share = (F.lit(start_fraction)
             + F.lit(1.0 - start_fraction) * (F.col("epoch") / F.lit(float(full))))
    count = F.greatest(F.lit(1), (share * F.col("total_batches")).cast("int"))
    return rows.select("run", "epoch", F.when(F.col("epoch") >= full, F.col("total_batches"))
                       .otherwise(count).cast("int").alias("n_active"))


@SCHEDULES.register("adaptive", tags=["pacing", "adaptive", "prefix"])
def adaptive(runs: DataFrame, total_epochs: int, epochs: DataFrame = None,
             signals: DataFrame = None, start_fraction: float = 0.3, window: int = 5,
             **_) -> DataFrame:
    """Prefix grows each epoch by at least the floor that finishes in time, and up to three
    times that floor at full readiness."""
    return pace(runs, readiness(epochs, signals, window), total_epochs, start_fraction)


def pace(runs: DataFrame, ready: DataFrame, total_epochs: int,
         start_fraction: float = 0.3) -> DataFrame:
    """Batch counts from readiness. The recurrence folds over one run's epochs in order."""
    check_fraction(start_fraction)
    steps = ready.groupBy("run").agg(F.array_sort(F.collect_list(
        F.struct("epoch", "readiness"))).alias("steps"))  # at most total_epochs entries
    total = F.col("total_batches").cast("long")
    start = F.greatest(F.lit(1), (total * F.lit(start_fraction)).cast("long"))

    def advance(state, step):
        left = total - state["active"]
        epochs_left = F.lit(total_epochs).cast("long") - step["epoch"]
        floor = F.when(epochs_left > 0, F.greatest(
            F.lit(1).cast("long"), F.ceil(ratio(left.cast("double"), epochs_left.cast("double"))
                                          ))).otherwise(left)
        most = F.least(left, floor * 3)
        add = (floor + step["readiness"] * (most - floor)).cast("long")
        add = F.greatest(F.lit(1).cast("long"), F.least(add, left))
        active = F.when(left <= 0, total).otherwise(state["active"] + add)
        return F.struct(active.alias("active"), F.concat(state["counts"], F.array(F.struct(
            step["epoch"].alias("epoch"), active.cast("int").alias("n_active"))))
            .alias("counts"))

    initial = F.struct(start.alias("active"), F.array().cast(
        "array<struct<epoch:int,n_active:int>>").alias("counts"))
    folded = steps.join(runs.select("run", "total_batches"), "run").select(
        "run", F.explode(F.aggregate("steps", initial, advance, lambda s: s["counts"]))
        .alias("c"))
    return folded.select("run", F.col("c.epoch").alias("epoch"), F.col("c.n_active"))


def running_means(runs: DataFrame, signals: DataFrame, value: str,
                  total_epochs: int) -> DataFrame:
    """``run, epoch, batch_idx, mean``: mean of all values a batch reported so far, on the full
    epoch x batch grid; 0.0 before the first report.

    Observations are turned into epoch intervals first, so the shuffle carries the reports and
    one row per batch, and the dense grid appears only after it.
    """
    grid = expand_range(runs.select("run", "total_batches"), F.col("total_batches"),
                        "batch_idx").select("run", F.col("batch_idx").cast("int"),
                                            F.lit(0).alias("epoch"),
                                            F.lit(None).cast("double").alias("_value"))
    reports = signals.where(F.col(value).isNotNull()).select(
        "run", F.col("batch_idx").cast("int"), F.col("epoch").cast("int"),
        F.col(value).cast("double").alias("_value"))
    order = Window.partitionBy("run", "batch_idx").orderBy("epoch")
    spans = grid.unionByName(reports).select(
        "run", "batch_idx", "epoch",
        F.coalesce(F.avg("_value").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                   F.lit(0.0)).alias("mean"),
        F.lead("epoch", 1, total_epochs + 1).over(order).alias("_next"),
        F.min("epoch").over(Window.partitionBy("run", "batch_idx")).alias("_first"))
    spans = spans.where("_first = 0").withColumns({
        "_from": F.greatest("epoch", F.lit(1)),
        "_to": F.least(F.col("_next") - 1, F.lit(total_epochs))}).where("_from <= _to")
    return spans.select("run", "batch_idx", "mean",
                        F.explode(F.sequence("_from", "_to")).alias("epoch"))


def signal_order(runs: DataFrame, total_epochs: int, signals: DataFrame, value: str,
                 smooth_window: int = 5, cold_start_epochs: int = 1,
                 digits: int | None = None) -> DataFrame:
    """All batches every epoch, by descending smoothed running mean of a batch signal.

    Natural order during the cold start and while no batch has reported (all means are 0).
    """
    means = running_means(runs, signals, value, total_epochs)
    return order_by_means(means, smooth_window, cold_start_epochs, digits)


def order_by_means(means: DataFrame, smooth_window: int = 5, cold_start_epochs: int = 1,
                   digits: int | None = None) -> DataFrame:
    """`signal_order` from the running means of all batches (``run, epoch, batch_idx, mean``)."""
    smooth = smooth_centered(means, "mean", "_smooth", smooth_window // 2)
    key = F.round("_smooth", digits) if digits is not None else F.col("_smooth")
    smooth = smooth.withColumn("_key", F.when(F.col("epoch") <= cold_start_epochs, F.lit(0.0))
                               .otherwise(key))
    return positions(smooth, [F.col("_key").desc(), F.col("batch_idx").asc()],
                     keep=["batch_idx"], by=["run", "epoch"], label="signal-order").select(
                         "run", "epoch", F.col("position").cast("int").alias("slot"),
                         "batch_idx")


@SCHEDULES.register("gradient", tags=["pacing", "adaptive", "gradient-informed"])
def gradient(runs: DataFrame, total_epochs: int, signals: DataFrame = None,
             start_fraction: float = 0.3, **options) -> DataFrame:
    check_fraction(start_fraction)
    options.pop("epochs", None)
    return signal_order(runs, total_epochs, signals, "mean_grad_norm", **options)


@SCHEDULES.register("uncertainty", tags=["pacing", "adaptive", "uncertainty-informed"])
def uncertainty(runs: DataFrame, total_epochs: int, signals: DataFrame = None,
                start_fraction: float = 0.3, **options) -> DataFrame:
    check_fraction(start_fraction)
    options.pop("epochs", None)
    return signal_order(runs, total_epochs, signals, "mean_entropy", **options)


def exposure(order: DataFrame, runs: DataFrame, total_epochs: int) -> DataFrame:
    """What each epoch exposes: everything in epoch 1, then the order of the epoch before."""
    later = (order.withColumn("epoch", (F.col("epoch") + 1).cast("int"))
             .where(F.col("epoch") <= total_epochs))
    first = expand_range(runs.select("run", "total_batches"), F.col("total_batches"), "slot")
    first = first.select("run", F.lit(1).alias("epoch"), F.col("slot").cast("int"),
                         F.col("slot").cast("int").alias("batch_idx"))
    return first.unionByName(later.select("run", F.col("epoch"), "slot", "batch_idx"))


def exposure_counts(counts: DataFrame, runs: DataFrame, total_epochs: int) -> DataFrame:
    """`exposure` for prefix schedules, kept as counts."""
    later = counts.select("run", (F.col("epoch") + 1).cast("int").alias("epoch"), "n_active")
    first = runs.select("run", F.lit(1).alias("epoch"), F.col("total_batches").cast("int")
                        .alias("n_active"))
    return first.unionByName(later.where(F.col("epoch") <= total_epochs))


def exposure_statistics(counts: DataFrame, runs: DataFrame, total_epochs: int) -> DataFrame:
    """Per (run, epoch): batches exposed, share of all, running total; and the run's DSI."""
    so_far = (Window.partitionBy("run").orderBy("epoch")
              .rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("run")
    capacity = F.col("total_batches").cast("double") * total_epochs
    return (counts.join(runs.select("run", "total_batches"), "run").select(
        "run", "epoch", "n_active",
        ratio(F.col("n_active").cast("double"), F.col("total_batches").cast("double"))
        .alias("share"),
        F.sum("n_active").over(so_far).cast("long").alias("cumulative_batches"),
        F.round(1.0 - ratio(F.sum("n_active").over(whole).cast("double"), capacity), 4)
        .alias("dsi")))
