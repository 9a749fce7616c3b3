"""As-of joins without pairs.

Both tables are laid one into the other in time order and the last value of the right one is carried
to the rows of the left. The order is cut into ranges of rows, whatever their keys: a range carries
its own values, and what reaches into it comes from a table of one row for each range and key. So a
key with any share of the rows is spread over tasks, and nothing is multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import named
from lehrplan.operators.ordering import positions
from lehrplan.sources.staging import stage

RANGE = 1 << 18


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str],
              until: str | None = None, rows: int = RANGE) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the last row of ``right`` with equal ``by`` whose
    ``on`` is no later; missing where there is none.

    With ``until``, a column of ``right``, a row holds only for times before it. Of rows of ``right``
    with equal ``by`` and ``on`` the largest by ``values`` holds. Rows of ``left`` with a missing
    ``on`` or key match nothing and stay. ``rows`` is the length of a range.
    """
    by, carried = list(by), [*values, *([until] if until else [])]
    held = F.struct(*[named(v).alias(v) for v in carried])
    # of several rows at one time one holds
    last = right.where(" and ".join(f"`{c}` is not null" for c in (on, *by))).groupBy(
        *[named(b) for b in by], named(on)).agg(F.max(held).alias("_held"))
    none = F.lit(None).cast(last.schema["_held"].dataType)
    own = F.struct(*[named(c).alias(c) for c in left.columns])
    # the columns of the left row travel in one struct, so no names can clash
    both = left.select(*[named(b).alias(f"_b{i}") for i, b in enumerate(by)], named(on).alias("_on"),
                       F.lit(1).alias("_side"), none.alias("_held"), own.alias("_own"),
                       F.xxhash64(own).alias("_tie")).unionByName(
        last.select(*[named(b).alias(f"_b{i}") for i, b in enumerate(by)], named(on).alias("_on"),
                    F.lit(0).alias("_side"), "_held", F.lit(0).cast("long").alias("_tie")),
        allowMissingColumns=True)
    keys = [f"_b{i}" for i in range(len(by))]
    placed = stage(positions(both, [F.col(c).asc_nulls_first() for c in (*keys, "_on", "_side", "_tie")],
                             keep=[*keys, "_on", "_side", "_held", "_own"], label="asof").withColumn(
        "_range", F.floor(F.col("position") / rows)), "asof-ranges")
    ends = placed.where("_side = 0").groupBy("_range", *keys).agg(F.max_by("_held", "position").alias("_end"))
    marks = placed.select("_range", *keys).distinct().join(ends, ["_range", *keys], "left")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    marks = stage(marks.select(F.col("_range").alias("_mrange"), *[F.col(k).alias(f"_m{k}") for k in keys],
                               F.last("_end", ignorenulls=True).over(earlier).alias("_before")), "asof-marks")
    inside = (Window.partitionBy("_range", *keys).orderBy("position")
              .rowsBetween(Window.unboundedPreceding, 0))
    match = F.col("_range") == F.col("_mrange")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_m{k}"))
    found = placed.withColumn("_here", F.last("_held", ignorenulls=True).over(inside)).where(
        "_side = 1").join(marks, match, "left").withColumn("_value", F.coalesce("_here", "_before"))
    valid = F.col("_on").isNotNull()
    if until:
        valid = valid & (F.col("_value")[until].isNull() | (F.col("_on") < F.col("_value")[until]))
    return found.select("_own.*", *[F.when(valid, F.col("_value")[v]).alias(v) for v in values])
