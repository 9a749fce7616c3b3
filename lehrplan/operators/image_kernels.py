"""Image metrics and image preparation as vectorised passes over Arrow batches.

Images of equal shape are stacked and processed together; edges, gray planes and wavelet levels
are computed once per stack and shared by the metrics that use them. A failing image yields
missing scores and an entry in ``errors``; it never fails the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lehrplan.functions.images import LUMA, level_energy, level_entropy, seeded_int
from lehrplan.registry import METRICS

STACK_VALUES = 1 << 22  # values processed together, so temporaries stay small
FEED_VALUES = 1 << 20   # values read or made together when images are prepared


def daubechies(order: int) -> np.ndarray:
    """Scaling filter with ``order`` vanishing moments (2*order taps), by spectral factorisation:
    keep the roots inside the unit circle."""
    outer = np.poly1d([1.0])
    for _ in range(order):
        outer *= np.poly1d([1.0, 1.0])
    half = np.poly1d([1.0])
    if order > 1:
        y = np.roots([comb(order - 1 + k, k) for k in range(order - 1, -1, -1)])
        for root in y:  # y = (2 - z - 1/z) / 4
            pair = np.roots([1.0, 4.0 * root - 2.0, 1.0])
            half *= np.poly1d([1.0, -pair[np.argmin(np.abs(pair))]])
    taps = np.real((outer * half).coeffs)
    return taps * (np.sqrt(2.0) / taps.sum())


def wavelet_filters(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Low- and high-pass decomposition filters of ``haar`` or ``db1`` to ``db10``."""
    order = 1 if wavelet == "haar" else int(wavelet[2:]) if wavelet[:2] == "db" else 0
    if not 1 <= order <= 10:
        raise ValueError(f"unknown wavelet '{wavelet}'; use haar or db1..db10")
    low = daubechies(order)
    signs = np.where(np.arange(len(low)) % 2 == 0, 1.0, -1.0)
    return low[::-1], -(low * signs)


def split_band(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filter and halve along the last axis, borders mirrored half-sample."""
    size, n = len(taps), x.shape[-1]
    count = (n + size - 1) // 2
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(size - 2, size - 1)], mode="symmetric")
    out = np.zeros(x.shape[:-1] + (count,))
    for j, tap in enumerate(taps):
        first = size - 1 - j
        out += tap * wide[..., first:first + 2 * count - 1:2]
    return out


def wavelet_levels(gray: np.ndarray, wavelet: str = "db2", level: int | None = None
                   ) -> np.ndarray:
    """Detail energy per decomposition level, coarsest first: shape (images, levels)."""
    low, high = wavelet_filters(wavelet)
    side = min(gray.shape[1:])
    deepest = int(np.floor(np.log2(side / (len(low) - 1)))) if side >= len(low) - 1 else 0
    energies = []
    approx = gray.astype(float)
    for _ in range(deepest if level is None else level):
        along = [split_band(approx, f) for f in (low, high)]
        bands = [split_band(b.swapaxes(1, 2), f).swapaxes(1, 2)
                 for b in along for f in (low, high)]
        approx = bands[0]
        energies.append(sum((b ** 2).sum(axis=(1, 2)) for b in bands[1:]))
    return np.array(energies[::-1]).T.reshape(len(gray), -1)


def sobel_stack(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical 3x3 Sobel responses, borders replicated."""
    g = np.pad(gray.astype(np.int32), ((0, 0), (1, 1), (1, 1)), mode="edge")
    smooth_y = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    smooth_x = g[:, :, :-2] + 2 * g[:, :, 1:-1] + g[:, :, 2:]
    return (smooth_y[:, :, 2:] - smooth_y[:, :, :-2],
            smooth_x[:, 2:] - smooth_x[:, :-2])


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected component label per pixel of each image (the smallest member pixel's id,
    background = size): neighbour minimum plus pointer jumping until nothing changes."""
    none = mask.size
    ids = np.arange(none).reshape(mask.shape)
    label = np.where(mask, ids, none)
    while True:
        wide = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        rows = np.minimum(np.minimum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
        near = np.minimum(np.minimum(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:])
        parent = np.append(label.ravel(), none)
        lower = np.where(mask, parent[np.where(mask, near, none)], none)
        if np.array_equal(lower, label):
            return label
        label = lower


def canny(gray: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Edge mask: non-maximum suppression of the L1 gradient, then weak edges (> low) kept where
    their component holds a strong one (> high)."""
    gx, gy = sobel_stack(gray)
    ax, ay = np.abs(gx), np.abs(gy)
    magnitude = ax + ay
    wide = np.pad(magnitude, ((0, 0), (1, 1), (1, 1)))
    at = lambda dy, dx: wide[:, 1 + dy:wide.shape[1] - 1 + dy, 1 + dx:wide.shape[2] - 1 + dx]
    flat, steep = np.tan(np.pi / 8), np.tan(3 * np.pi / 8)  # sector borders 22.5 and 67.5 deg
    across = (magnitude > at(0, -1)) & (magnitude >= at(0, 1))
    upright = (magnitude > at(-1, 0)) & (magnitude >= at(1, 0))
    falling = (magnitude > at(-1, -1)) & (magnitude > at(1, 1))
    rising = (magnitude > at(-1, 1)) & (magnitude > at(1, -1))
    peak = np.where(ay < flat * ax, across, np.where(
        ay > steep * ax, upright, np.where((gx < 0) != (gy < 0), rising, falling)))
    weak = peak & (magnitude > low)
    strong = weak & (magnitude > high)
    label = components(weak)
    held = np.zeros(weak.size + 1, dtype=bool)
    held[label[strong]] = True
    held[-1] = False
    return held[label]


class Stack:
    """Images of one shape, with the planes that metrics share."""

    def __init__(self, data: np.ndarray, options: dict):
        self.data = data  # (images, channels, height, width), float32
        self.options = options

    def option(self, metric: str, name: str):
        given = self.options.get(metric, {})
        return given.get(name, METRICS.get(metric).config.get(name))

    @cached_property
    def mean_gray(self) -> np.ndarray:
        return self.data.astype(float).mean(axis=1)

    @cached_property
    def byte_gray(self) -> np.ndarray:
        channels = self.data.shape[1]
        if channels not in (1, 3):
            raise ValueError(f"luma needs 1 or 3 channels, got {channels}")
        if channels == 1:
            return as_bytes(self.data[:, 0])
        weights = np.array(LUMA)
        gray = np.einsum("bchw,c->bhw", self.data.astype(float), weights)
        return as_bytes(gray.astype(np.float32))

    def edges(self, metric: str) -> np.ndarray:
        key = (self.option(metric, "low"), self.option(metric, "high"))
        cache = self.__dict__.setdefault("_edges", {})
        if key not in cache:
            cache[key] = canny(self.byte_gray, *key)
        return cache[key]

    def levels(self, metric: str) -> np.ndarray:
        key = (self.option(metric, "wavelet"), self.option(metric, "level"))
        cache = self.__dict__.setdefault("_levels", {})
        if key not in cache:
            cache[key] = wavelet_levels(self.mean_gray, *key)
        return cache[key]


def as_bytes(planes: np.ndarray) -> np.ndarray:
    """Per image: times 255 if no value exceeds 1, clamped to 0..255, truncated."""
    top = planes.reshape(len(planes), -1).max(axis=1)
    factor = np.where(top <= 1.0, np.float32(255), np.float32(1)).astype(np.float32)
    grown = planes * factor.reshape((-1,) + (1,) * (planes.ndim - 1))
    return np.clip(grown, 0, 255).astype(np.uint8)


@METRICS.register("color-variance", tags=["complexity"], input="images")
def color_variance(stack: Stack) -> np.ndarray:
    x = stack.data.reshape(*stack.data.shape[:2], -1).astype(float)
    return x.var(axis=2, ddof=1).mean(axis=1)


@METRICS.register("compression-ratio", tags=["complexity", "inverted"], input="images", level=6)
def compression_ratio(stack: Stack) -> np.ndarray:
    """Raw bytes over losslessly compressed bytes of the interleaved byte image."""
    level = stack.option("compression-ratio", "level")
    planes = as_bytes(stack.data).transpose(0, 2, 3, 1)
    return np.array([p.nbytes / len(zlib.compress(p.tobytes(), level)) for p in planes])


@METRICS.register("edge-density", tags=["complexity"], input="images", low=100, high=200)
def edge_density(stack: Stack) -> np.ndarray:
    edges = stack.edges("edge-density")
    return edges.reshape(len(edges), -1).mean(axis=1)


@METRICS.register("object-count", tags=["complexity"], input="images", low=100, high=200)
def object_count(stack: Stack) -> np.ndarray:
    """Components of the edge mask grown by one pixel."""
    wide = np.pad(stack.edges("object-count"), ((0, 0), (1, 1), (1, 1)))
    rows = wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:]
    grown = rows[:, :, :-2] | rows[:, :, 1:-1] | rows[:, :, 2:]
    ids = np.arange(grown.size).reshape(grown.shape)
    return (components(grown) == ids).reshape(len(grown), -1).sum(axis=1).astype(float)


@METRICS.register("spatial-frequency", tags=["complexity"], input="images")
def spatial_frequency(stack: Stack) -> np.ndarray:
    g = stack.mean_gray
    down, across = np.diff(g, axis=1) ** 2, np.diff(g, axis=2) ** 2
    return np.sqrt(down.mean(axis=(1, 2)) + across.mean(axis=(1, 2)))


WAVELET = {"input": "images", "wavelet": "db2", "level": None}


@METRICS.register("wavelet-energy", tags=["complexity", "wavelet-decomposition"], **WAVELET)
def wavelet_energy(stack: Stack) -> np.ndarray:
    total = stack.levels("wavelet-energy").sum(axis=1)
    return np.where(total < 1e-6, 0.0, total)


@METRICS.register("wavelet-entropy", tags=["complexity", "wavelet-decomposition"], **WAVELET)
def wavelet_entropy(stack: Stack) -> np.ndarray:
    levels = stack.levels("wavelet-entropy")
    total = levels.sum(axis=1, keepdims=True)
    flat = total[:, 0] < 1e-6
    share = levels / np.where(flat[:, None], 1.0, total)
    bits = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
    depth = np.log2(levels.shape[1]) if levels.shape[1] > 1 else 1.0
    return np.where(flat, 0.0, bits / depth)


# The Arrow pass ---------------------------------------------------------------------------

def image_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """Shapes (rows x 3, -1 where unusable) and the flat value array of every row."""
    shapes = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in "chw"], axis=1)
    shapes = np.nan_to_num(shapes.astype(float), nan=-1).astype(int)
    lists = batch.column("data")
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    ends = lists.offsets.to_numpy()
    rows = [values[ends[i]:ends[i + 1]] for i in range(len(lists))]
    expected = np.maximum(shapes, 0).prod(axis=1)
    broken = [lists[i].as_py() is None if len(rows[i]) == 0 else len(rows[i]) != expected[i]
              for i in range(len(rows))]
    broken = np.array(broken, dtype=bool) | (expected == 0)
    shapes[broken] = -1
    return shapes, rows


def stacks(shapes: np.ndarray, rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, stacked data) of usable rows, grouped by shape, in bounded pieces."""
    usable = np.flatnonzero(shapes[:, 0] > 0)
    kinds, kind = np.unique(shapes[usable], axis=0, return_inverse=True)
    for k, shape in enumerate(kinds):
        members = usable[kind.ravel() == k]
        step = max(1, STACK_VALUES // int(shape.prod()))
        for start in range(0, len(members), step):
            part = members[start:start + step]
            yield part, np.stack([rows[i] for i in part]).reshape(len(part), *shape)


def pieces(batch: pa.RecordBatch, made: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch that read or make a bounded number of values (or one image);
    ``made`` counts the values that each row becomes."""
    held = batch.column("data").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cost = np.maximum(held, made).astype(np.int64)
    number = (np.cumsum(cost) - cost) // FEED_VALUES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), batch.num_rows]
    for start, stop in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, stop - start)


def run_kernels(data: np.ndarray, kernels: dict[str, Callable], options: dict
                ) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Scores per metric and, per image, the text of what failed."""
    scores, errors = {}, [dict() for _ in data]
    stack = Stack(data, options)
    for metric, kernel in kernels.items():
        try:
            value = kernel(stack)
        except Exception as problem:
            if len(data) == 1:
                value = np.array([np.nan])
                errors[0][metric] = f"{type(problem).__name__}: {problem}"
            else:  # isolate the failing images
                parts = [run_kernels(data[i:i + 1], {metric: kernel}, options)
                         for i in range(len(data))]
                value = np.array([p[0][metric][0] for p in parts], dtype=object)
                for i, part in enumerate(parts):
                    errors[i].update(part[1][0])
        scores[metric] = value
    return scores, errors


def write_stacks(rows: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Arrow lists (NULL where no stack covers a row) from (row numbers, stacked data)."""
    flat: list = [None] * rows
    for members, data in parts:
        for i, image in zip(members, data.reshape(len(members), -1)):
            flat[i] = image
    sizes = np.array([0 if v is None else len(v) for v in flat])
    values = [v for v in flat if v is not None]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32(),
                       mask=np.array([*[v is None for v in flat], False]))
    return pa.ListArray.from_arrays(offsets, pa.array(
        np.concatenate(values) if values else [], type=pa.float32()))


def crop_and_mirror(data: np.ndarray, size: int, padding: int, dy: np.ndarray, dx: np.ndarray,
                    mirror: np.ndarray) -> np.ndarray:
    """``size`` x ``size`` windows at (dy, dx) of the zero-padded images, some mirrored."""
    count, channels, height, width = data.shape
    room = [max(side + 2 * padding, size) for side in (height, width)]
    wide = np.zeros((count, channels, *room), dtype=data.dtype)
    wide[:, :, padding:padding + height, padding:padding + width] = data
    y, x = dy[:, None] + np.arange(size), dx[:, None] + np.arange(size)
    x[mirror] = x[mirror, ::-1]
    return wide[np.arange(count)[:, None, None, None], np.arange(channels)[:, None, None],
                y[:, None, :, None], x[:, None, None, :]]


def feed(images: DataFrame, size: int | None = None, padding: int = 0, flip: bool = False,
         seed: int = 1, mean: Sequence[float] | None = None,
         std: Sequence[float] | None = None) -> DataFrame:
    """Crop (with ``size``), mirror and normalise images in one Arrow pass.

    Offsets and coins are drawn per sample from (seed, index), so a retry or another
    partitioning draws the same.
    """
    draw = lambda kind, bound: seeded_int(seed, kind, F.col("index"), bound)
    room = lambda side: F.greatest(F.lit(1), F.col(side) + 2 * padding - (size or 0) + 1)
    drawn = {"_dy": draw("dy", room("h")) if size else F.lit(0),
             "_dx": draw("dx", room("w")) if size else F.lit(0),
             "_mirror": (draw("flip", 2) if flip else F.lit(0)) == 1}
    images = images.withColumns({n: F.col(n).cast("int") for n in "chw"}).withColumn(
        "data", F.col("data").cast("array<float>"))
    kept, names = [c for c in images.columns if c != "data"], list(drawn)

    def change(data: np.ndarray, members: np.ndarray, draws: dict) -> np.ndarray:
        if size:
            data = crop_and_mirror(data, size, padding, *[draws[n][members] for n in names])
        if mean is not None:
            shape = (1, -1, 1, 1)
            data = (data.astype(float) - np.reshape(mean, shape)) / np.reshape(std, shape)
        return data.astype(np.float32)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels = batch.column("c").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield from pieces(batch, channels * (size or 0) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):  # a crop may be much larger than its image
            shapes, rows = image_arrays(batch)
            draws = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            data = write_stacks(len(rows), ((m, change(d, m, draws))
                                            for m, d in stacks(shapes, rows)))
            columns = {n: batch.column(n) for n in kept}
            if size:
                side = pa.array(np.full(len(rows), size, dtype=np.int32))
                columns |= {"h": side, "w": side}
            yield pa.RecordBatch.from_arrays([*columns.values(), data], names=[*kept, "data"])

    schema = T.StructType([*[images.schema[n] for n in kept],
                           T.StructField("data", T.ArrayType(T.FloatType()))])
    return images.select(*kept, "data", *[c.alias(n) for n, c in drawn.items()]).mapInArrow(
        run, schema)


def image_metric_ids() -> list[str]:
    return [m for m in METRICS.ids() if METRICS.get(m).config.get("input") == "images"]


def score_images(images: DataFrame, metrics: Sequence[str] | None = None,
                 options: dict[str, dict] | None = None, wanted: str | None = None) -> DataFrame:
    """``index, class, <metric> double..., errors map``: all metrics in one pass, no shuffle.

    ``options`` overrides metric parameters: ``{"edge-density": {"low": 50}}``. ``wanted`` names
    an array column with the metrics to compute for a row; the others stay missing.
    """
    metrics = list(metrics or image_metric_ids())
    kernels = {m: METRICS.get(m).build for m in metrics}
    options = options or {}
    kept = images.select("index", F.col("class").cast("string").alias("class"),
                         *[F.col(n).cast("int").alias(n) for n in "chw"],
                         F.col("data").cast("array<float>").alias("data"),
                         (F.col(wanted) if wanted else F.lit(None)).cast("array<string>")
                         .alias("wanted"))
    text = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("index", pa.int64()), ("class", pa.string()),
                        *[(m, pa.float64()) for m in metrics], ("errors", text)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, rows = image_arrays(batch)
            scores = {m: np.full(len(rows), np.nan) for m in metrics}
            asked = [tuple(metrics if names is None else [m for m in metrics if m in names])
                     for names in batch.column("wanted").to_pylist()]
            errors = [dict.fromkeys(names, "unusable image") if s[0] < 0 else {}
                      for s, names in zip(shapes, asked)]
            for members, data in stacks(shapes, rows):
                for names in dict.fromkeys(asked[i] for i in members):
                    part = np.array([asked[i] == names for i in members])
                    found, failed = run_kernels(data if part.all() else data[part],
                                                {m: kernels[m] for m in names}, options)
                    for m in names:
                        scores[m][members[part]] = found[m].astype(float)
                    for i, e in zip(members[part], failed):
                        errors[i].update(e)
            columns = [batch.column("index").cast(pa.int64()), batch.column("class")]
            columns += [pa.array(np.where(np.isfinite(scores[m]), scores[m], np.nan),
                                 from_pandas=True) for m in metrics]
            columns.append(pa.array([list(e.items()) for e in errors], type=text))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    fields = ", ".join(["index long", "class string", *[f"`{m}` double" for m in metrics],
                        "errors map<string,string>"])
    return kept.mapInArrow(score, fields)


def sobel_table(images: DataFrame) -> DataFrame:
    """``index, y, x, gx, gy, magnitude`` of the byte image's luma, without a shuffle; unusable
    images have no pixels."""
    kept = images.select("index", *[F.col(n).cast("int").alias(n) for n in "chw"],
                         F.col("data").cast("array<float>").alias("data"))
    planes = pa.list_(pa.int32())
    schema = pa.schema([("index", pa.int64()), ("w", pa.int32()), ("gx", planes), ("gy", planes)])

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, rows = image_arrays(batch)
            found: list = [[None] * len(rows), [None] * len(rows)]
            for members, data in stacks(shapes, rows):
                for out, slope in zip(found, sobel_stack(Stack(data, {}).byte_gray)):
                    flat = slope.reshape(len(members), -1).astype(np.int32)
                    for i, values in zip(members, flat):
                        out[i] = values
            yield pa.RecordBatch.from_arrays(
                [batch.column("index").cast(pa.int64()), batch.column("w"),
                 *[pa.array(out, type=planes) for out in found]], schema=schema)

    table = kept.mapInArrow(slopes, "index long, w int, gx array<int>, gy array<int>")
    pixel = table.select("index", "w", F.posexplode(F.arrays_zip("gx", "gy")).alias("p", "e"))
    return pixel.select("index", F.expr("cast(p div w as int)").alias("y"),
                        F.expr("cast(p % w as int)").alias("x"), "e.gx", "e.gy",
                        (F.abs("e.gx") + F.abs("e.gy")).alias("magnitude"))


def wavelet_table(images: DataFrame, wavelet: str = "db2", level: int | None = None
                  ) -> DataFrame:
    """``index, levels array<double>, energy, entropy``: one transform for both metrics, which
    are then native expressions on the level energies."""
    kept = images.select("index", *[F.col(n).cast("int").alias(n) for n in "chw"],
                         F.col("data").cast("array<float>").alias("data"))
    schema = pa.schema([("index", pa.int64()), ("levels", pa.list_(pa.float64()))])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, rows = image_arrays(batch)
            levels: list = [None] * len(rows)
            for members, data in stacks(shapes, rows):
                found = wavelet_levels(data.astype(float).mean(axis=1), wavelet, level)
                for i, energies in zip(members, found):
                    levels[i] = energies
            yield pa.RecordBatch.from_arrays(
                [batch.column("index").cast(pa.int64()),
                 pa.array(levels, type=schema.field("levels").type)], schema=schema)

    table = kept.mapInArrow(transform, "index long, levels array<double>")
    return table.select("index", "levels", level_energy(F.col("levels")).alias("energy"),
                        level_entropy(F.col("levels")).alias("entropy"))
