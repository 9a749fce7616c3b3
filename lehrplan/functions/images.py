"""Expressions on images stored as flat ``(C, H, W)`` arrays with columns ``c, h, w, data``.

These run inside Spark expressions and suit small images and ad-hoc use. Whole-corpus scoring
goes through the Arrow pass in ``operators.image_kernels``, which shares work between metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lehrplan.functions.columns import let


def area() -> Column:
    return F.col("h") * F.col("w")


def span(count: Column) -> Column:
    """0 .. count-1 (empty for 0)."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def average(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def scaled(data: Column) -> Column:
    """0..255 to 0..1."""
    return F.transform(data, lambda x: (x.cast("float") / F.lit(255.0)).cast("float"))


def gray_mean(data: Column) -> Column:
    """Mean over channels, as doubles."""
    plane = lambda d, p: F.aggregate(span(F.col("c")), F.lit(0.0), lambda s, k:
                                     s + F.get(d, k * area() + p).cast("double"))
    several = let(data, lambda d: F.transform(
        span(area()), lambda p: plane(d, p) / F.col("c").cast("double")))
    return F.when(F.col("c") == 1, data.cast("array<double>")).otherwise(several)


# ITU-R BT.601 luma weights. Fixed values.
LUMA = (0.299, 0.587, 0.114)


def gray_luma(data: Column) -> Column:
    """Weighted sum of three channels; one channel is taken as it is."""
    r, g, b = LUMA
    weighted = let(data, lambda d: F.transform(span(area()), lambda p: (
        F.get(d, p).cast("double") * r + F.get(d, area() + p).cast("double") * g
        + F.get(d, area() * 2 + p).cast("double") * b).cast("float")))
    return F.when(F.col("c") == 1, data.cast("array<float>")).when(F.col("c") == 3, weighted)


def to_bytes(data: Column) -> Column:
    """Values in 0..255: scaled up only if no value exceeds 1, clamped, truncated.

    The product is taken in single precision, where k/255*255 gives k back.
    """
    zero, top = F.lit(0).cast("float"), F.lit(255).cast("float")
    largest = F.array_max(data)
    factor = F.when(largest <= 1.0, top).otherwise(F.lit(1).cast("float"))
    return let(factor, lambda f: F.transform(data, lambda x: F.greatest(zero, F.least(
        top, (x.cast("float") * f).cast("float"))).cast("int")))


def channel_variances(data: Column) -> Column:
    """Sample variance (N-1) of each channel."""
    def variance(values: Column) -> Column:
        squares = let(average(values), lambda mean: F.aggregate(
            values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)))
        return squares / F.nullif(F.size(values).cast("double") - 1.0, F.lit(0.0))

    channels = F.transform(span(F.col("c")), lambda k: F.slice(data, k * area() + 1, area()))
    return F.transform(channels, lambda v: let(v.cast("array<double>"), variance))


def color_variance(data: Column) -> Column:
    return average(channel_variances(data))


def row_frequency(gray: Column) -> Column:
    """RMS difference between vertical neighbours."""
    steps = let(gray, lambda g: F.zip_with(
        F.slice(g, F.col("w") + 1, F.greatest(area() - F.col("w"), F.lit(0))),
        F.slice(g, 1, F.greatest(area() - F.col("w"), F.lit(0))), lambda a, b: a - b))
    return let(F.transform(steps, lambda d: d * d), lambda q: F.sqrt(average(q)))


def column_frequency(gray: Column) -> Column:
    """RMS difference between horizontal neighbours."""
    inner = F.filter(span(area()), lambda p: p % F.col("w") < F.col("w") - 1)
    steps = let(gray, lambda g: F.transform(inner, lambda p: F.get(g, p + 1) - F.get(g, p)))
    return let(F.transform(steps, lambda d: d * d), lambda q: F.sqrt(average(q)))


def spatial_frequency(data: Column) -> Column:
    return let(gray_mean(data), lambda g: F.sqrt(
        F.pow(row_frequency(g), F.lit(2.0)) + F.pow(column_frequency(g), F.lit(2.0))))


def level_energy(levels: Column) -> Column:
    energy = total(levels)
    return F.when(energy < 1e-6, F.lit(0.0)).otherwise(energy)


def level_entropy(levels: Column) -> Column:
    """Entropy (bits) of level energies as shares, divided by log2(levels); 0 for flat images."""
    energy = total(levels)
    share = let(F.nullif(energy, F.lit(0.0)),
                lambda t: F.transform(levels, lambda e: e / t))
    bits = -total(F.transform(F.filter(share, lambda p: p > 0), lambda p: p * F.log2(p)))
    count = F.size(levels)
    return (F.when(energy < 1e-6, F.lit(0.0))
            .when(count > 1, bits / F.log2(F.greatest(count, F.lit(2)))).otherwise(bits))


def seeded_int(seed: int, kind: str, index: Column, bound: Column | int) -> Column:
    """Reproducible integer in [0, bound) per row."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{kind}"), index.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % bound).cast("int")
