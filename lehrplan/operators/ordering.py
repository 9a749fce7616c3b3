"""Global positions without a single-partition window.

Rows are range-partitioned on the full sort key *including the unique tie-break*, so a key
value shared by a third of all rows is still cut into even partitions. The sorted rows are
staged once with their partition number and row number; a position is then the row number
plus the number of rows in earlier partitions, which is a sum over one small row per
partition. Staging matters for correctness, not only speed: range bounds come from sampling
and would differ if the sort were evaluated twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import hash_order, named
from lehrplan.sources.staging import stage


def positions(df: DataFrame, order: Sequence[Column], keep: Sequence[str],
              by: Sequence[str] = (), label: str = "positions",
              with_size: bool = False) -> DataFrame:
    """Add the 0-based ``position`` of each row in ``order`` (within ``by`` groups if given).

    ``order`` must end with columns that make it unique. Returns ``by`` + ``keep`` columns
    and ``position``; a group may span any number of partitions. ``with_size`` also adds the
    row count of the group as ``size``.
    """
    by = list(by)
    sort = [named(b).asc_nulls_first() for b in by] + list(order)
    part = F.spark_partition_id()
    row = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    carried = by + [k for k in keep if k not in by]
    placed = stage(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
          .select(*[named(c) for c in carried], part.alias("_part"), row.alias("_row")),
        label)

    # one row per (partition, group): at most #partitions + #groups rows
    marks = placed.groupBy("_part", *[named(b) for b in by]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = (Window.partitionBy(*[named(b) for b in by]).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if with_size:
        group = Window.partitionBy(*[named(b) for b in by])
        marks = marks.withColumn("size", F.sum("_n").over(group))
    size = ["size"] if with_size else []

    if not by:
        placed = placed.join(F.broadcast(marks), "_part")  # one row per partition
    else:
        # staged so that the planner knows its size: broadcast while small, shuffled beyond
        marks = stage(marks.select(F.col("_part").alias("_mpart"), "_first", "_before", *size,
                                   *[named(b).alias(f"_m_{b}") for b in by]), f"{label}-marks")
        match = F.col("_part") == F.col("_mpart")
        for b in by:
            match = match & named(b).eqNullSafe(named(f"_m_{b}"))
        placed = placed.join(marks, match)
    return placed.select(
        *[named(c) for c in carried],
        (F.col("_before") + F.col("_row") - F.col("_first")).alias("position"),
        *size)


def shuffled(df: DataFrame, seed: int = 1, index: str = "index",
             keep: Sequence[str] = ()) -> DataFrame:
    """Positions of a seeded shuffle; stable under any partitioning, unlike ``rand()``."""
    keyed = df.withColumn("_shuffle", hash_order(seed, named(index)))
    return positions(keyed, [F.col("_shuffle").asc(), named(index).asc()],
                     keep=[index, *[k for k in keep if k != index]], label="shuffle")


def expand_range(df: DataFrame, count: Column, out: str, block: int = 1 << 16) -> DataFrame:
    """One row per integer in ``[0, count)``.

    Explodes block numbers first and spreads them over the cluster before exploding inside
    each block, so no task or array holds a whole long range.
    """
    wide = df.withColumn("_count", count.cast("long")).where(F.col("_count") > 0)
    wide = wide.withColumn("_block", F.explode(
        F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {block}"))))
    spread = wide.repartition(*[named(c) for c in df.columns
                                if df.schema[c].dataType.typeName() not in ("map",)], "_block")
    start = F.col("_block") * block
    stop = F.least(start + block, F.col("_count")) - 1
    return (spread.withColumn(out, F.explode(F.sequence(start, stop)))
                  .drop("_count", "_block"))
