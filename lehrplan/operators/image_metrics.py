"""Image tables: transforms, pixel relation, augmentation, native metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lehrplan.functions import images as I
from lehrplan.operators.image_kernels import feed


def scale(images: DataFrame) -> DataFrame:
    return images.withColumn("data", I.scaled(F.col("data")))


def normalize(images: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """Subtract a mean and divide by a deviation per channel."""
    return feed(images, mean=mean, std=std)


def augment(images: DataFrame, size: int, padding: int = 4, flip: bool = True,
            seed: int = 1) -> DataFrame:
    """Random pad-and-crop to ``size`` x ``size`` and a fair-coin mirror, reproducible per
    sample."""
    return feed(images, size, padding, flip, seed)


def pixels(images: DataFrame) -> DataFrame:
    """One row per value: ``index, ch, y, x, v``."""
    rows = images.select("index", "h", "w", F.posexplode("data").alias("p", "v"))
    area = F.col("h") * F.col("w")
    return rows.select("index", F.floor(F.col("p") / area).cast("int").alias("ch"),
                       F.floor((F.col("p") % area) / F.col("w")).cast("int").alias("y"),
                       (F.col("p") % F.col("w")).cast("int").alias("x"),
                       F.col("v").cast("double").alias("v"))


def sobel(images: DataFrame) -> DataFrame:
    """``index, y, x, gx, gy, magnitude`` of the byte image's luma: 3x3 Sobel with replicated
    borders and L1 magnitude, as windows over the pixel relation."""
    gray = images.select("index", "h", "w", I.gray_luma(F.col("data")).alias("data"))
    rows = pixels(gray.withColumn("data", I.to_bytes(F.col("data")))).select(
        "index", "y", "x", F.col("v").cast("int").alias("v"))
    line = Window.partitionBy("index", "y").orderBy("x")
    column = Window.partitionBy("index", "x").orderBy("y")
    near = lambda c, step, w: F.coalesce((F.lag if step < 0 else F.lead)(c, 1).over(w), F.col(c))
    rows = rows.select("index", "y", "x",
                       (near("v", 1, line) - near("v", -1, line)).alias("d"),
                       (near("v", -1, line) + F.col("v") * 2 + near("v", 1, line)).alias("s"))
    rows = rows.select("index", "y", "x",
                       (near("d", -1, column) + F.col("d") * 2 + near("d", 1, column))
                       .alias("gx"),
                       (near("s", 1, column) - near("s", -1, column)).alias("gy"))
    return rows.withColumn("magnitude", F.abs("gx") + F.abs("gy"))


NATIVE = {"color-variance": I.color_variance, "spatial-frequency": I.spatial_frequency}


def native_metrics(images: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Metrics that are plain expressions, in one projection without a shuffle."""
    return images.select("index", "class", *[NATIVE[m](F.col("data")).alias(m) for m in metrics or NATIVE])


def frequencies(images: DataFrame) -> DataFrame:
    """Row and column parts of the spatial frequency."""
    gray = images.withColumn("_gray", I.gray_mean(F.col("data")))
    return gray.select("index", I.row_frequency(F.col("_gray")).alias("row_frequency"),
                       I.column_frequency(F.col("_gray")).alias("column_frequency"))
