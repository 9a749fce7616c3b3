"""Distribution statistics of every metric, over the whole table and per class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.functions.columns import metric_columns, named, present
from lehrplan.sources.staging import stage

QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
GLOBAL = "global"


def melt(scores: DataFrame, metrics: Sequence[str] | None = None, index: str = "index",
         label: str = "class") -> DataFrame:
    """``index, class, metric, value`` with one row per sample and metric."""
    metrics = list(metrics or metric_columns(scores, (index, label)))
    clean = scores.select(named(index).alias("index"), named(label).alias("class"),
                          *[present(named(m)).alias(m) for m in metrics])
    return clean.unpivot(["index", "class"], [named(m) for m in metrics], "metric", "value")


def moments() -> list[Column]:
    return [F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.max("value").alias("maximum"), F.min("value").alias("minimum"),
            F.stddev_samp("value").alias("std")]


def with_ordered_bits(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add a double as a long in the same order: its 64 bits, those of a negative number's
    magnitude negated. Both zeros are 0; NaN has no place.

    The exponent from a logarithm may be off by one and is put right; powers of two and the
    division by one are exact, so the long holds every bit of the number.
    """
    one = 1 << 52
    return (rows.withColumn("_size", F.abs(named(value)))
            .withColumn("_e", F.expr("cast(floor(log2(least(greatest(_size, pow(2.0D, -1022)), "
                                     "1.7976931348623157E308D))) as int)"))
            .withColumn("_e", F.expr("if(pow(2.0D, _e) > _size, _e - 1, "
                                     "if(pow(2.0D, _e + 1) <= _size, _e + 1, _e))"))
            .withColumn(out, F.signum(named(value)).cast("long") * F.expr(f"""
                case when _size = double('infinity') then {2047 * one}L
                     when _size < pow(2.0D, -1022)
                     then cast(_size * pow(2.0D, 537) * pow(2.0D, 537) as long)
                     else (_e + 1022) * {one}L + cast(_size / pow(2.0D, _e) * {one} as long) end"""))
            .drop("_size", "_e"))


def exact_quantiles(values: DataFrame, by: Sequence[str], quantiles: dict[str, float],
                    extra: Sequence[Column] = (), bits: int = 16) -> DataFrame:
    """Linearly interpolated quantiles per group, by counting alone.

    Doubles are compared by their ordered 64 bits, ``bits`` at a time from the highest. A pass
    counts the values of every leading pattern still wanted, for all groups and quantiles
    together; the pattern that holds a wanted position is known from the counts, and only values
    with it go into the next pass. After ``64 / bits`` passes the values themselves are known.
    Counts are combined before they are shuffled, so a group may hold any share of the rows, and
    nothing is sorted, sampled or collected.

    Missing values and NaN are ignored; a group without others has NULL quantiles. ``extra`` holds aggregates
    of the group, added as columns.
    """
    by = list(by)
    keys = [named(b) for b in by]
    values = values.withColumn("value", present(F.col("value").cast("double")))
    sizes = stage(values.groupBy(*keys).agg(F.count("value").alias("_n"), *extra), "sizes")
    places = {n: (F.greatest(F.col("_n"), F.lit(1)) - 1) * q for n, q in quantiles.items()}
    wanted = F.array_distinct(F.array(*[f(p) for p in places.values() for f in (F.floor, F.ceil)]))
    targets = sizes.where("_n > 0").select(*keys, F.lit(0).cast("long").alias("_pattern"),
                                           F.lit(0).cast("long").alias("_base"), wanted.alias("_wanted"))

    rows = with_ordered_bits(values.where("value is not null").select(*keys, "value"), "value", "_key")
    shift, old = 64 - bits, ["_pattern", "_base", "_wanted"]
    found = _patterns(rows.join(*per_group(targets, by)), by, shift)
    while shift > 0:  # the rows of the patterns found, and no others, go on
        known, match, _ = per_group(found.select(*keys, *old), by)
        inside = match & (F.shiftright("_key", shift) == F.col("_pattern"))
        rows = stage(rows.join(known, inside).select(*keys, "value", "_key", *old), "patterns") \
            if shift == 64 - bits else rows.drop(*old).join(known, inside).select(*keys, "value", "_key", *old)
        shift = max(0, shift - bits)
        found = _patterns(rows, by, shift)

    ends = found.select(*keys, F.explode("_wanted").alias("_place"), "_value").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "_value"))).alias("_at"))  # two a quantile
    solved = sizes.join(*per_group(ends, by))
    at = lambda place: F.try_element_at("_at", place)
    extras = [c for c in sizes.columns if c not in by and c != "_n"]
    return solved.select(*keys, *extras, *[interpolated(
        at(F.floor(p)), at(F.ceil(p)), p - F.floor(p), F.ceil(p) - p).alias(n)
        for n, p in places.items()])


def _patterns(rows: DataFrame, by: list[str], shift: int) -> DataFrame:
    """The leading patterns of ``_key`` that hold wanted positions: ``by``, ``_pattern``, the rows
    of the group before it (``_base``), the positions in it (``_wanted``) and its largest value.

    ``rows`` carry what is known of the shorter pattern they were chosen by, in the same columns.
    """
    old = [*[named(b) for b in by], F.col("_pattern").alias("_old"), "_base", "_wanted"]
    counts = rows.groupBy(*old, F.shiftright("_key", shift).alias("_pattern")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("value").alias("_value"))
    # at most 2 ** bits patterns in an older one
    order = (Window.partitionBy(*[named(b) for b in by], "_old").orderBy("_pattern")
             .rowsBetween(Window.unboundedPreceding, -1))
    base = F.col("_base") + F.coalesce(F.sum("_n").over(order), F.lit(0))
    held = F.filter("_wanted", lambda p: (p >= F.col("_base")) & (p < F.col("_base") + F.col("_n")))
    return stage(counts.withColumn("_base", base).withColumn("_wanted", held).where(
        F.size("_wanted") > 0).select(*[named(b) for b in by], "_pattern", "_base", "_wanted", "_value"),
        "found")


def per_group(table: DataFrame, by: list[str]) -> tuple[DataFrame, Column, str]:
    """Left-join arguments for a table with one row per group. A staged one has a known size, so
    the planner broadcasts it while it is small."""
    other = table.select(*[named(b).alias(f"_s_{b}") for b in by],
                         *[c for c in table.columns if c not in by])
    match = reduce(lambda p, q: p & q, [named(b).eqNullSafe(named(f"_s_{b}")) for b in by])
    return other, match, "left"


def interpolated(low: Column, high: Column, share: Column, rest: Column) -> Column:
    """Point between two neighbours, with the arithmetic of the built-in aggregate."""
    return F.when(low == high, low).otherwise(low * rest + high * share)


def distributions(scores: DataFrame, metrics: Sequence[str] | None = None,
                  index: str = "index", label: str = "class", **quantile_options) -> DataFrame:
    """One row per metric and scope (``global`` or a class): count, mean, maximum, median,
    minimum, std (N-1), p25, p50, p75. Missing scores are skipped."""
    values = melt(scores, metrics, index, label)
    # each value counts once for its class and once for the whole table
    levels = F.when(F.col("class").isNull(), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))
    scoped = (values.withColumn("level", F.explode(levels))
              .withColumn("class", F.when(F.col("level") == 1, F.col("class"))))
    by = ["metric", "level", "class"]
    table = exact_quantiles(scoped, by, QUANTILES, extra=moments(), **quantile_options)
    scope = F.when(F.col("level") == 0, F.lit(GLOBAL)).otherwise(F.col("class"))
    return table.select("metric", scope.alias("scope"), "count", "mean", "maximum",
                         F.col("p50").alias("median"), "minimum", "std", "p25", "p50", "p75")


def classes(scores: DataFrame, label: str = "class") -> DataFrame:
    return scores.select(named(label).alias("class")).distinct()
