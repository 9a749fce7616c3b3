"""Image tables: ``index, class, split, c, h, w, data`` with ``data`` flat (C, H, W) floats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lehrplan.operators.image_kernels import feed, stacks, write_stacks
from lehrplan.operators.ordering import positions
from lehrplan.registry import DATASETS
from lehrplan.sources.staging import stage


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Interleaved BGR(A) bytes to RGB planes in [0, 1], images of one shape together."""
    for batch in batches:
        shapes = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in "hwc"], axis=1)
        shapes = np.nan_to_num(shapes.astype(float), nan=-1).astype(int)
        raw = batch.column("bytes")
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
        values = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        whole = np.array([len(r) for r in rows]) == np.maximum(shapes, 0).prod(axis=1)
        shapes[~whole | (shapes <= 0).any(axis=1)] = -1

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for members, data in stacks(shapes, rows):
                if data.shape[3] >= 3:
                    data = data[..., [2, 1, 0, *range(3, data.shape[3])]]
                yield members, data.transpose(0, 3, 1, 2).astype(np.float32) / 255

        keep = [n for n in batch.schema.names if n != "bytes"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep],
                                          write_stacks(batch.num_rows, parts())], [*keep, "data"])


def with_planes(images: DataFrame) -> DataFrame:
    """``data`` instead of ``bytes``, which are decoded pixels; NULL for a file that is no image."""
    fields = [f for f in images.schema.fields if f.name != "bytes"]
    return images.mapInArrow(_planes, T.StructType(
        [*fields, T.StructField("data", T.ArrayType(T.FloatType()))]))


def plain_path(path: Column) -> Column:
    """Readers spell the scheme of a path with one slash or three."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Image files (PNG, JPEG, ...) decoded by Spark's own reader: ``origin, c, h, w, bytes``.

    A file that is no image keeps its row, with sizes of -1; scoring it gives errors."""
    i = F.col("image")
    return spark.read.format("image").load(path).select(
        plain_path(i["origin"]).alias("origin"), i["nChannels"].alias("c"),
        i["height"].alias("h"), i["width"].alias("w"), i["data"].alias("bytes"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``origin, c, h, w, data`` of image files."""
    return with_planes(decoded(spark, path))


TASK_FILES = 4096  # files of a task, as a task for every few would cost more than their pixels


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Folder tree ``root/<split>/<class>/<file>``; indices follow path order within a split.

    Only the paths are sorted. The pixels meet their index in one join, as bytes: without moving
    while the list of paths is small, hashed by path beyond.
    """
    root, tasks = root.rstrip("/"), 4 * spark.sparkContext.defaultParallelism
    several = bool(set(root) & set("*?[{"))
    tree = f"{root}/*/*/*" if several else f"{root}/*/*"  # folders: a file as a path takes a task
    paths = spark.read.format("binaryFile").load(tree).coalesce(tasks).select(
        plain_path(F.col("path")).alias("path"))  # contents are not read
    if not several:  # a file beside the class folders is no image of the corpus
        below = re.escape(re.sub("^([a-z0-9]+:)?[./]*/", "", root)) + "/[^/]+/[^/]+/[^/]"
        paths = paths.where(F.col("path").rlike(below))
    part = lambda back: F.element_at(F.split("path", "/"), -back)
    places = positions(paths.withColumns({"split": part(3), "class": part(2)}),
                       [F.col("path").asc()], by=["split"], keep=["path", "class"],
                       label="corpus")
    ids = stage(places, "corpus-index")
    images = decoded(spark, tree).coalesce(max(tasks, ids.count() // TASK_FILES))
    return with_planes(images.join(ids, images["origin"] == ids["path"]).select(
        F.col("position").alias("index"), "class", "split", "c", "h", "w", "bytes"))


# Image size and classes of the corpora; crop, padding, mirroring and channel statistics that
# training images get. Fixed values.
CORPORA = {
    "mnist": {"tags": ["grayscale"], "channels": 1, "size": 28, "classes": 10, "crop": 32,
              "padding": 4, "flip": False, "mean": (0.5,), "std": (0.5,)},
    "cifar-10": {"tags": ["rgb"], "channels": 3, "size": 32, "classes": 10, "crop": 32,
                 "padding": 4, "flip": True, "mean": (0.4914, 0.4822, 0.4465),
                 "std": (0.2023, 0.1994, 0.2010)},
    "cifar-100": {"tags": ["rgb"], "channels": 3, "size": 32, "classes": 100, "crop": 32,
                  "padding": 4, "flip": True, "mean": (0.5071, 0.4865, 0.4409),
                  "std": (0.2673, 0.2564, 0.2761)},
    "imagenet": {"tags": ["rgb", "large-scale"], "channels": 3, "size": 256, "classes": 1000,
                 "crop": 224, "padding": 4, "flip": True, "mean": (0.485, 0.456, 0.406),
                 "std": (0.229, 0.224, 0.225)},
}
for _id, _facts in CORPORA.items():
    DATASETS.register(_id, tags=_facts["tags"],
                      **{k: v for k, v in _facts.items() if k != "tags"})(read_corpus)


def prepare(images: DataFrame, corpus: str, train: bool = True, seed: int = 1) -> DataFrame:
    """Images as a network is fed them: training images cropped and mirrored at random, then all
    normalised per channel. Metrics read the images before this step."""
    facts = DATASETS.get(corpus).config
    crop = (facts["crop"], facts["padding"], facts["flip"]) if train else ()
    return feed(images, *crop, seed=seed, mean=facts["mean"], std=facts["std"])


def load_corpus(spark: SparkSession, id: str, root: str) -> DataFrame:
    return DATASETS.get(id).build(spark, root)


def corpus_facts(images: DataFrame) -> DataFrame:
    """Size, class count and sample shape per split."""
    return images.groupBy("split").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("class").cast("int")
        .alias("num_classes"),
        *[F.min(F.when(F.col(n) > 0, F.col(n))).alias(name) for n, name in
          (("c", "channels"), ("h", "height"), ("w", "width"))])


def stored_compression(spark: SparkSession, path: str) -> DataFrame:
    """Raw size over file size for images already stored compressed; no codec involved."""
    shapes = decoded(spark, path).select(
        "origin", F.when(F.col("c") > 0, F.col("h") * F.col("w") * F.col("c")).cast("double")
        .alias("_raw"))
    files = spark.read.format("binaryFile").load(path).select(
        plain_path(F.col("path")).alias("origin"), "length")
    return shapes.join(files, "origin").select(
        "origin", (F.col("_raw") / F.col("length")).alias("compression-ratio"))


# Synthetic images -------------------------------------------------------------------------

# Names and RGB values of the synthetic corpus. Fixed values.
SOLIDS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0),
          "green": (0, 255, 0), "blue": (0, 0, 255), "cyan": (0, 255, 255),
          "magenta": (255, 0, 255), "yellow": (255, 255, 0)}
PAIRS = {"black_white": ("black", "white"), "red_cyan": ("red", "cyan"),
         "green_magenta": ("green", "magenta"), "blue_yellow": ("blue", "yellow")}
TILES = (2, 4, 8, 16, 32, 64)


def sample_specs(spark: SparkSession, size: int = 64) -> DataFrame:
    """``index, name, size, tiles, color_a, color_b``; a solid is a board of equal colours."""
    rows = [(f"solid_{n}", 1, c, c) for n, c in SOLIDS.items()]
    rows += [(f"checker_{p}_{t}x{t}", t, SOLIDS[a], SOLIDS[b])
             for p, (a, b) in PAIRS.items() for t in TILES if t <= size]
    return spark.createDataFrame(
        [(i, n, size, t, list(a), list(b)) for i, (n, t, a, b) in enumerate(rows)],
        "index long, name string, size int, tiles int, color_a array<int>, color_b array<int>")


def boards(size: int, tiles: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Boards (n, 3, size, size) in [0, 1] for n colour pairs: odd tiles take the first colour."""
    line = np.arange(size) // (size // tiles)
    odd = (line[:, None] + line) % 2 == 1
    pick = lambda colours: colours[:, :, None, None].astype(float) / 255
    return np.where(odd, pick(first), pick(second)).astype(np.float32)


def synthesize(specs: DataFrame) -> DataFrame:
    """Images of a spec table, one row each, drawn inside the executors."""
    size = F.col("size").cast("int")
    rows = specs.select(
        "index", F.col("name").alias("class"), F.lit("train").alias("split"),
        F.lit(3).alias("c"), size.alias("h"), size.alias("w"), "tiles", "color_a", "color_b")
    kept = rows.columns[:6]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(n).to_numpy(zero_copy_only=False)
                              for n in ("h", "tiles")], axis=1)
            colours = [np.array(batch.column(n).to_pylist()).reshape(-1, 3)
                       for n in ("color_a", "color_b")]
            parts = ((np.flatnonzero((kinds == k).all(axis=1)), k)
                     for k in np.unique(kinds, axis=0))
            data = write_stacks(len(kinds), ((m, boards(*k.tolist(), *[c[m] for c in colours]))
                                             for m, k in parts))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], data],
                                             names=[*kept, "data"])

    schema = T.StructType([*[rows.schema[n] for n in kept],
                           T.StructField("data", T.ArrayType(T.FloatType()))])
    return rows.mapInArrow(draw, schema)
