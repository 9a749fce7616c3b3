"""Model-informed difficulty from logged training histories.

Inputs are long tables: ``history(index, iteration, loss)`` and
``layer_history(index, layer, iteration, delta)``. The two metrics look at ``max_iterations``
iterations, their parameter; deltas and histories are whole unless a cut is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import named
from lehrplan.registry import METRICS

DEFAULTS = {"threshold": 1e-3, "window": 5, "max_iterations": 1000}


PIECE = 1 << 16  # iterations of a series that are read in one task


def stable_runs(series: DataFrame, delta: str, keys: list[str], threshold: float,
                longest: int | None = None, piece: int = PIECE) -> DataFrame:
    """Add ``stable_run``: consecutive steps ending here whose ``delta`` is below threshold.

    A missing or larger delta resets the run to 0. Series of at most ``longest`` iterations are read
    whole where that is no more than a piece. Others are cut at multiples of ``piece``: each piece
    is summed up by its rows and the run it ends with, those sums merge in order, and the run that
    reaches into a piece is added to its rows before the first break.
    """
    unstable = F.col(delta).isNull() | (F.col(delta) >= threshold)
    whole = longest is not None and longest <= piece
    rows = series if whole else series.withColumn("_piece", _piece(piece))
    inside = [*keys, *([] if whole else ["_piece"])]
    order = Window.partitionBy(*inside).orderBy("iteration")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_n", F.row_number().over(order)).withColumn(
        "_break", F.max(F.when(unstable, F.col("_n"))).over(so_far))
    own = F.col("_n") - F.coalesce("_break", F.lit(0))
    if whole:
        return numbered.withColumn("stable_run", own.cast("int")).drop("_n", "_break")
    # a row for each piece: its rows, and those after its last break (its tail) if it has one
    sums = numbered.groupBy(*inside).agg(F.count(F.lit(1)).alias("_rows"), F.max("_break").alias("_broken"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    tail = F.col("_rows") - F.col("_broken")
    known = sums.select(*inside, "_rows", (F.sum("_rows").over(upto) - tail).alias("_base"))
    carry = (F.coalesce(F.sum("_rows").over(before), F.lit(0))
             - F.coalesce(F.last("_base", ignorenulls=True).over(before), F.lit(0)))
    carries = known.select(*[named(k).alias(f"_k_{k}") for k in inside], carry.alias("_carry"))
    found = numbered.join(carries, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inside])
    return found.select(*[named(c) for c in series.columns], (
        own + F.when(F.col("_break").isNull(), F.col("_carry")).otherwise(0)).cast("int").alias("stable_run"))


def _piece(piece: int) -> Column:
    return F.floor(F.col("iteration") / F.lit(piece)).cast("long")


def up_to(rows: DataFrame, max_iterations: int | None) -> DataFrame:
    return rows if max_iterations is None else rows.where(F.col("iteration") <= max_iterations)


def loss_deltas(history: DataFrame, max_iterations: int | None = None, piece: int = PIECE) -> DataFrame:
    """Add ``delta = |loss - previous loss|``, missing for the first iteration.

    Without a bound of at most ``piece`` iterations, a series is read in pieces; the first row of
    each takes the last loss of the piece before from a table of one row a piece.
    """
    rows = up_to(history, max_iterations)
    if max_iterations is not None and max_iterations <= piece:
        order = Window.partitionBy("index").orderBy("iteration")
        return rows.withColumn("delta", F.abs(F.col("loss") - F.lag("loss").over(order)))
    rows = rows.withColumn("_piece", _piece(piece))
    inside = Window.partitionBy("index", "_piece").orderBy("iteration")
    ends = rows.groupBy("index", "_piece").agg(F.max_by(F.struct("loss"), "iteration").alias("_end"))
    ends = ends.select(F.col("index").alias("_index"), F.col("_piece").alias("_after"), F.lag("_end").over(
        Window.partitionBy("index").orderBy("_piece")).alias("_end"))
    placed = rows.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_lag", F.lag("loss").over(inside)).join(
        ends, F.col("index").eqNullSafe(F.col("_index")) & (F.col("_piece") == F.col("_after")))
    previous = F.when(F.col("_row") == 1, F.col("_end.loss")).otherwise(F.col("_lag"))
    return placed.select(*[named(c) for c in history.columns],
                         F.abs(F.col("loss") - previous).alias("delta"))


@METRICS.register("convergence-time", tags=["model-informed"], input="history", **DEFAULTS)
def convergence_time(history: DataFrame, threshold: float = 1e-3, window: int = 5,
                     max_iterations: int = 1000) -> DataFrame:
    """``index, value, converged, final_loss``: the iteration completing ``window`` consecutive
    loss changes below ``threshold``, else the last iteration."""
    runs = stable_runs(loss_deltas(history, max_iterations), "delta", ["index"], threshold, max_iterations)
    done = F.col("stable_run") >= window
    found = runs.groupBy("index").agg(
        F.min(F.when(done, F.col("iteration"))).alias("_hit"),
        F.max("iteration").alias("_last"),
        F.min_by("loss", F.when(done, F.col("iteration"))).alias("_hit_loss"),
        F.max_by("loss", "iteration").alias("_last_loss"))
    hit = F.col("_hit").isNotNull()
    return found.select(
        "index", F.coalesce("_hit", "_last").cast("double").alias("value"),
        hit.alias("converged"),
        F.when(hit, F.col("_hit_loss")).otherwise(F.col("_last_loss")).alias("final_loss"))


def layer_saturation(layer_history: DataFrame, threshold: float = 1e-3, window: int = 5,
                     max_iterations: int = 1000) -> DataFrame:
    """``index, layer, start, completed, last``: where each layer's run of small weight changes
    began (-1 if it never reached ``window``) and was completed."""
    cut = layer_history.where(F.col("iteration") <= max_iterations)
    runs = stable_runs(cut, "delta", ["index", "layer"], threshold, max_iterations)
    found = runs.groupBy("index", "layer").agg(
        F.min(F.when(F.col("stable_run") >= window, F.col("iteration"))).alias("completed"),
        F.max("iteration").alias("last"))
    return found.select("index", "layer",
                        F.coalesce(F.col("completed") - window + 1, F.lit(-1)).cast("int")
                        .alias("start"), "completed", "last")


@METRICS.register("saturation-time", tags=["model-informed"], input="layer_history", **DEFAULTS)
def saturation_time(layer_history: DataFrame, threshold: float = 1e-3, window: int = 5,
                    max_iterations: int = 1000) -> DataFrame:
    """``index, value, saturated``: the iteration at which the last layer settled, else the
    last iteration logged."""
    layers = layer_saturation(layer_history, threshold, window, max_iterations)
    found = layers.groupBy("index").agg(
        F.min(F.col("completed").isNotNull()).alias("saturated"),
        F.max("completed").alias("_completed"), F.max("last").alias("_last"))
    return found.select("index", F.when(F.col("saturated"), F.col("_completed"))
                        .otherwise(F.col("_last")).cast("double").alias("value"), "saturated")


def weight_deltas(snapshots: DataFrame, max_iterations: int | None = None) -> DataFrame:
    """Frobenius norm of the change between successive weight snapshots of a layer.

    ``snapshots(index, layer, iteration, weights array)`` from iteration 0 on; the result starts
    at the second snapshot.
    """
    order = Window.partitionBy("index", "layer").orderBy("iteration")
    cut = up_to(snapshots, max_iterations)
    pairs = cut.withColumn("_before", F.lag("weights").over(order))
    squares = F.aggregate(
        F.zip_with("weights", "_before",
                   lambda a, b: (a.cast("double") - b.cast("double"))
                   * (a.cast("double") - b.cast("double"))),
        F.lit(0.0), lambda s, x: s + x)
    return (pairs.where("_before is not null")
            .select("index", "layer", "iteration", F.sqrt(squares).alias("delta")))


def until_settled(runs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """The rows of every series up to the one that completes ``window`` stable steps."""
    hits = runs.where(F.col("stable_run") >= window).groupBy(*keys).agg(F.min("iteration").alias("_hit"))
    hits = hits.select(*[named(k).alias(f"_k_{k}") for k in keys], "_hit")
    return runs.join(hits, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").where(
        F.col("_hit").isNull() | (F.col("iteration") <= F.col("_hit"))).select(*runs.columns)


def history_chunks(history: DataFrame, threshold: float = 1e-3, window: int = 5,
                   max_iterations: int | None = None, piece: int = PIECE) -> DataFrame:
    """`histories` in rows of at most ``piece`` iterations, for series of any length: ``index, chunk,
    first_iteration, loss_history, loss_delta_history``; chunks without rows are left out."""
    rows = stable_runs(loss_deltas(history, max_iterations, piece), "delta", ["index"], threshold,
                       max_iterations, piece)
    kept = until_settled(rows, ["index"], window)
    ordered = F.array_sort(F.collect_list(F.struct("iteration", "loss", "delta")))
    return kept.groupBy("index", _piece(piece).alias("chunk")).agg(ordered.alias("_s")).select(
        "index", "chunk", F.get("_s", F.lit(0))["iteration"].alias("first_iteration"),
        F.transform("_s", lambda s: s["loss"]).alias("loss_history"),
        F.transform(F.filter("_s", lambda s: s["delta"].isNotNull()), lambda s: s["delta"])
        .alias("loss_delta_history"))


def histories(history: DataFrame, threshold: float = 1e-3, window: int = 5,
              max_iterations: int | None = None) -> DataFrame:
    """Loss and loss-change series per sample, up to the iteration where fitting would stop; each is
    one array, so for series that fit a row (`history_chunks` has no such bound)."""
    rows = stable_runs(loss_deltas(history, max_iterations), "delta", ["index"], threshold, max_iterations)
    kept = until_settled(rows, ["index"], window)
    ordered = F.array_sort(F.collect_list(F.struct("iteration", "loss", "delta")))
    series = kept.groupBy("index").agg(ordered.alias("_s"))
    return series.select(
        "index", F.transform("_s", lambda s: s["loss"]).alias("loss_history"),
        F.transform(F.filter("_s", lambda s: s["delta"].isNotNull()), lambda s: s["delta"])
        .alias("loss_delta_history"))


def layer_histories(layer_history: DataFrame, threshold: float = 1e-3, window: int = 5,
                    max_iterations: int | None = None) -> DataFrame:
    """Weight-change series per sample and layer, up to the iteration where the layer settled."""
    rows = stable_runs(up_to(layer_history, max_iterations), "delta", ["index", "layer"], threshold,
                       max_iterations)
    return until_settled(rows, ["index", "layer"], window).groupBy("index", "layer").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("iteration", "delta"))), lambda s: s["delta"])
        .alias("weight_delta_history"))
