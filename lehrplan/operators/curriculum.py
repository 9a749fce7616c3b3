"""Scopes, batches and the active order of an epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lehrplan.functions.columns import hash_order, named
from lehrplan.operators.ordering import positions
from lehrplan.operators.ranks import rank
from lehrplan.registry import RANKS

SCOPES = ("holistic", "batch-wise")


def cut(ranked: DataFrame, batch_size: int, index: str = "index") -> DataFrame:
    """Consecutive batches of a ranking; a short last batch is kept."""
    return ranked.select(
        F.expr(f"cast(position div {batch_size} as int)").alias("batch_idx"),
        (F.col("position") % batch_size).cast("int").alias("pos_in_batch"),
        named(index))


def holistic(scores: DataFrame, scheme: str, metrics, batch_size: int,
             index: str = "index", **options) -> DataFrame:
    return cut(rank(scores, scheme, metrics, index=index, **options), batch_size, index)


def batch_wise(scores: DataFrame, scheme: str, metrics, batch_size: int, seed: int = 1,
               index: str = "index", **options) -> DataFrame:
    """Shuffle all samples, cut into chunks, rank each chunk on its own."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, got {batch_size}")
    carried = [metrics] if isinstance(metrics, str) else list(metrics)
    if "all-columns" in RANKS.get(scheme).tags:
        carried = [c for c in scores.columns if c != index]
    keyed = scores.withColumn("_shuffle", hash_order(seed, named(index)))
    chunks = positions(keyed, [F.col("_shuffle").asc(), named(index).asc()],
                       keep=[index, *carried], label="chunks")
    chunks = chunks.withColumn("batch_idx", F.expr(f"cast(position div {batch_size} as int)"))
    chunks = chunks.withColumnRenamed("position", "_drawn")
    ranked = rank(chunks, scheme, metrics, partition_by="batch_idx", bounded=True, index=index,
                  row_order="_drawn", **options)
    return ranked.select("batch_idx", F.col("position").cast("int").alias("pos_in_batch"),
                         named(index))


def curriculum(scores: DataFrame, scheme: str, metrics, batch_size: int = 128,
               scope: str = "holistic", seed: int = 1, **options) -> DataFrame:
    """``batch_idx, pos_in_batch, index`` for a rank and scope."""
    if scope == "holistic":
        return holistic(scores, scheme, metrics, batch_size, **options)
    if scope == "batch-wise":
        return batch_wise(scores, scheme, metrics, batch_size, seed, **options)
    raise ValueError(f"invalid scope '{scope}'; valid scopes: {', '.join(SCOPES)}")


def baseline(samples: DataFrame, batch_size: int, seed: int | None = None,
             index: str = "index") -> DataFrame:
    """Batches without a curriculum: index order, or a seeded shuffle."""
    if seed is None:
        order = [named(index).asc()]
    else:
        samples = samples.withColumn("_shuffle", hash_order(seed, named(index)))
        order = [F.col("_shuffle").asc(), named(index).asc()]
    return cut(positions(samples, order, keep=[index], label="baseline"), batch_size, index)


def class_balanced(ranked: DataFrame, batch_size: int, index: str = "index",
                   label: str = "class") -> DataFrame:
    """Batches whose class shares follow the corpus, keeping the ranking inside each class.

    Sample r of a class with n samples is placed at fraction (r+1)/n of the whole order.
    """
    inside = positions(ranked, [F.col("position").asc(), named(index).asc()],
                       keep=[index], by=[label], label="class-order", with_size=True)
    spread = inside.withColumn(
        "_share", (F.col("position") + 1) / F.col("size").cast("double"))
    order = [F.col("_share").asc(), named(label).asc_nulls_first(), named(index).asc()]
    return cut(positions(spread.drop("position", "size"), order, keep=[index], label="class-balanced"),
               batch_size, index)


def batch_total(batches: DataFrame) -> Column:
    """Number of batches, as a scalar subquery."""
    return batches.agg((F.max("batch_idx") + 1).alias("n")).scalar()


def set_order(order: DataFrame, batches: DataFrame,
              keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Valid active order per epoch: duplicates stay, ids out of range go, and an epoch left
    with nothing exposes batch 0."""
    keys = list(keys)
    flagged = order.withColumn("_total", batch_total(batches)).withColumn(
        "_valid", (F.col("batch_idx") >= 0) & (F.col("batch_idx") < F.col("_total")))
    valid = flagged.where("_valid").select(*keys, "slot", "batch_idx")
    empty = (flagged.groupBy(*keys).agg(F.max("_valid").alias("_any"))
             .where(~F.coalesce(F.col("_any"), F.lit(False)))
             .select(*keys, F.lit(0).cast(order.schema["slot"].dataType).alias("slot"),
                     F.lit(0).cast(order.schema["batch_idx"].dataType).alias("batch_idx")))
    return valid.unionByName(empty)


def sequence(active: DataFrame, batches: DataFrame, keys: Sequence[str] = ("epoch",),
             index: str = "index") -> DataFrame:
    """Flattened sample order of each epoch: ``keys, position, index``. For any order, with
    repeated or missing batches; see the two forms below for those of schedules."""
    keys = list(keys)
    rows = active.join(batches, "batch_idx")
    return positions(rows, [F.col("slot").asc(), F.col("pos_in_batch").asc()],
                     keep=[index], by=keys, label="sequence").select(
                         *keys, "position", named(index))


def prefix_sequence(counts: DataFrame, batches: DataFrame, batch_size: int,
                    index: str = "index") -> DataFrame:
    """`sequence` for ``counts(epoch, n_active)``: batches 0..n_active-1 in order.

    All batches before the last are full, so positions are arithmetic. Each sample is repeated for
    the epochs that reach its batch; the epochs travel as one small array and nothing is shuffled.
    """
    reach = counts.agg(F.collect_list(F.struct("epoch", "n_active")).alias("e")).scalar()
    rows = batches.withColumn("_epochs", reach).withColumn("_e", F.explode(F.filter(
        "_epochs", lambda e: e["n_active"] > F.col("batch_idx"))))
    return rows.select(
        F.col("_e.epoch").alias("epoch"),
        (F.col("batch_idx").cast("long") * batch_size + F.col("pos_in_batch")).alias("position"),
        named(index))


def permuted_sequence(order: DataFrame, batches: DataFrame, batch_size: int,
                      index: str = "index") -> DataFrame:
    """`sequence` for orders ``(epoch, slot, batch_idx)`` that hold every batch once per epoch.

    Only batches after the short last one are shifted. The join moves the orders and the batches,
    not their product, and no sort follows.
    """
    last = batches.agg(F.max(F.struct("batch_idx", "pos_in_batch")).alias("l")).scalar()
    marked = order.withColumn("_last", last)
    slots = marked.where(F.col("batch_idx") == F.col("_last.batch_idx")).agg(
        F.map_from_entries(F.collect_list(F.struct("epoch", "slot"))).alias("s")).scalar()
    missing = batch_size - 1 - F.col("_last.pos_in_batch")
    placed = marked.withColumn("_slots", slots).select(
        "epoch", "batch_idx", (F.col("slot").cast("long") * batch_size - F.when(
            F.col("slot") > F.element_at("_slots", F.col("epoch")), missing).otherwise(0))
        .alias("_start"))
    return placed.join(batches, "batch_idx").select(
        "epoch", (F.col("_start") + F.col("pos_in_batch")).alias("position"), named(index))


def batch_samples(batches: DataFrame, samples: DataFrame, index: str = "index") -> DataFrame:
    """Samples with their batch coordinates."""
    return batches.join(samples, index)


def top_samples(scores: DataFrame, metric: str, count: int, index: str = "index") -> DataFrame:
    """First ``count`` samples in ascending order, without sorting the table."""
    return (scores.orderBy(named(metric).asc_nulls_last(), named(index).asc())
            .limit(count).select(named(index)))


def coverage(batches: DataFrame, scores: DataFrame, index: str = "index") -> DataFrame:
    """Indices that are missing from the batches, unknown to the scores, or repeated."""
    inside = batches.groupBy(named(index).alias("index")).agg(F.count(F.lit(1)).alias("_times"))
    known = scores.select(named(index).alias("_known"))
    joined = inside.join(known, F.col("index") == F.col("_known"), "full_outer")
    problem = (F.when(F.col("_times").isNull(), "missing")
               .when(F.col("_known").isNull(), "unknown")
               .when(F.col("_times") > 1, "repeated"))
    return (joined.select(F.coalesce("index", "_known").alias("index"),
                          problem.alias("problem")).where("problem is not null"))


def describe(df: DataFrame, scheme: str, metrics, scope: str) -> DataFrame:
    """Attach the curriculum's settings to its rows."""
    names = metrics if isinstance(metrics, str) else ",".join(metrics)
    return df.withColumns({"rank": F.lit(scheme), "metric": F.lit(names),
                           "scope": F.lit(scope)})
