"""Small column helpers: quoting, missing values, hash order, whole-table statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.sources.staging import stage


def named(name: str) -> Column:
    """Column by exact name (metric ids contain hyphens)."""
    return F.col(f"`{name}`")


def present(value: Column) -> Column:
    """Double with NaN turned into NULL, so that sorts and aggregates skip it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def hash_order(seed: int, index: Column) -> Column:
    """Reproducible shuffle key of a row: the same for any partitioning or retry."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), index.cast("string")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL on a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def correlation_parts(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Aggregates of the rows where both are present: covariance and the two deviations.

    `corr` itself raises on constant columns in ANSI mode; see `correlation`.
    """
    both = x.isNotNull() & y.isNotNull()
    return (F.covar_samp(x, y), F.stddev_samp(F.when(both, x)), F.stddev_samp(F.when(both, y)))


def correlation(cov: Column, sx: Column, sy: Column) -> Column:
    """Pearson's r from `correlation_parts`; NULL if a column is constant."""
    return ratio(cov, sx * sy)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside an array lambda an outer expression is evaluated again for every element; binding it
    first keeps the whole expression linear in the array length.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Groups:
    """Grouping column of a per-group operation. ``bounded`` groups (batches) fit in a task; floats
    of their rows are added in ``order``, so that no partitioning changes a bit of a sum."""
    column: str
    bounded: bool = False
    order: str | None = None


def with_statistics(df: DataFrame, statistics: dict[str, Column],
                    groups: Groups | None = None) -> DataFrame:
    """Add aggregate columns of the whole table, or of each group.

    The whole-table form is one scalar subquery returning a single struct, so it costs one
    aggregation pass and moves one row. Bounded groups use a window. Groups of any size are
    aggregated, staged (so the planner knows the size) and joined back.
    """
    if groups is None:
        row = df.agg(F.struct(*[a.alias(k) for k, a in statistics.items()]).alias("s")).scalar()
        return (df.withColumn("_statistics", row)
                  .withColumns({k: F.col("_statistics").getField(k) for k in statistics})
                  .drop("_statistics"))
    key = named(groups.column)
    if groups.bounded:
        window = Window.partitionBy(key)
        if groups.order:
            window = window.orderBy(named(groups.order).asc()).rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({k: a.over(window) for k, a in statistics.items()})
    table = stage(df.groupBy(key.alias("_group")).agg(
        *[a.alias(k) for k, a in statistics.items()]), "group-statistics")
    return df.join(table, key.eqNullSafe(F.col("_group")), "left").drop("_group")


def metric_columns(df: DataFrame, meta: Iterable[str] = ("index", "class")) -> list[str]:
    """Metric ids of a score table: every column that is not bookkeeping."""
    meta = set(meta)
    return [c for c in df.columns if c not in meta]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("index", "class")) -> list[str]:
    """Numeric score columns, as the weighted rank discovers them."""
    exclude = set(exclude)
    kinds = {"byte", "short", "integer", "long", "float", "double"}
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in kinds and f.name not in exclude]
