import json
import struct
import zlib
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lehrplan.functions import images as IX
from lehrplan.operators import image_kernels as K, image_metrics as M
from lehrplan.plans import scoring
from lehrplan.registry import DATASETS, METRICS
from lehrplan.sources import images as SI, scores as SC
from lehrplan.sources.staging import staging_path

IMAGE = ("index long, class string, split string, c int, h int, w int, data array<float>")


def frame(spark, arrays):
    """Arrays of shape (C, H, W) as an image table."""
    rows = [(i, "x", "train", *a.shape, [float(v) for v in a.ravel()])
            for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, IMAGE)


@pytest.fixture(scope="module")
def synthetic(spark):
    return K.score_images(SI.synthesize(SI.sample_specs(spark, 64))).toPandas().set_index("class")


def test_solids_are_zero(synthetic):
    solids = synthetic[synthetic.index.str.startswith("solid")]
    for m in ("color-variance", "edge-density", "object-count", "spatial-frequency",
              "wavelet-energy", "wavelet-entropy"):
        assert (solids[m] == 0).all(), m
    assert len(solids) == 8 and all(not e for e in synthetic["errors"])


def test_boards_are_harder_than_solids(synthetic):
    board, solid = synthetic.loc["checker_black_white_8x8"], synthetic.loc["solid_black"]
    assert board["color-variance"] > 0 and board["spatial-frequency"] > 0
    assert board["wavelet-energy"] > 0 and 0 <= board["wavelet-entropy"] <= 1
    assert 0 < board["edge-density"] <= 1
    assert solid["compression-ratio"] > board["compression-ratio"]
    assert synthetic.loc["checker_black_white_32x32", "spatial-frequency"] > \
        synthetic.loc["checker_black_white_2x2", "spatial-frequency"]
    assert synthetic.loc["checker_red_cyan_2x2", "color-variance"] > 0


def test_board_layout(spark):
    specs = spark.createDataFrame([(0, "b", 4, 2, [255, 0, 0], [0, 0, 255])],
                                  "index long, name string, size int, tiles int, "
                                  "color_a array<int>, color_b array<int>")
    data = np.array(SI.synthesize(specs).first()["data"]).reshape(3, 4, 4)
    odd = np.add.outer(np.arange(4) // 2, np.arange(4) // 2) % 2 == 1
    np.testing.assert_array_equal(data[0], odd * 1.0)   # odd tiles take the first colour
    np.testing.assert_array_equal(data[2], ~odd * 1.0)
    assert not data[1].any()


def test_native_expressions_equal_kernels(spark):
    rng = np.random.default_rng(3)
    images = frame(spark, [rng.random(s) for s in ((3, 5, 7), (1, 4, 4), (3, 8, 8), (2, 3, 9))])
    native = M.native_metrics(images).toPandas().set_index("index").sort_index()
    kernel = K.score_images(images, list(M.NATIVE)).toPandas().set_index("index").sort_index()
    for m in M.NATIVE:
        np.testing.assert_allclose(native[m], kernel[m], rtol=1e-9)


def test_color_variance_uses_n_minus_one():
    data = np.random.default_rng(0).random((2, 3, 4, 4)).astype(np.float32)
    want = data.reshape(2, 3, 16).astype(float).var(axis=2, ddof=1).mean(axis=1)
    np.testing.assert_allclose(K.color_variance(K.Stack(data, {})), want)


# Edges against a pixel-by-pixel restatement ------------------------------------------------

def canny_slow(gray, low, high):
    h, w = gray.shape
    at = lambda y, x: int(gray[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    gx, gy = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for d, k in ((-1, 1), (0, 2), (1, 1)):
                gx[y, x] += k * (at(y + d, x + 1) - at(y + d, x - 1))
                gy[y, x] += k * (at(y + 1, x + d) - at(y - 1, x + d))
    mag = np.abs(gx) + np.abs(gy)
    m = lambda y, x: mag[y, x] if 0 <= y < h and 0 <= x < w else 0
    weak = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            a, b, v = abs(gx[y, x]), abs(gy[y, x]), mag[y, x]
            if b < np.tan(np.pi / 8) * a:
                peak = v > m(y, x - 1) and v >= m(y, x + 1)
            elif b > np.tan(3 * np.pi / 8) * a:
                peak = v > m(y - 1, x) and v >= m(y + 1, x)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                peak = v > m(y - 1, x - s) and v > m(y + 1, x + s)
            weak[y, x] = peak and v > low
    edges, queue = np.zeros((h, w), bool), deque(zip(*np.nonzero(weak & (mag > high))))
    while queue:
        y, x = queue.popleft()
        if not edges[y, x]:
            edges[y, x] = True
            queue += [(j, i) for j in range(max(y - 1, 0), min(y + 2, h))
                      for i in range(max(x - 1, 0), min(x + 2, w)) if weak[j, i]]
    return edges


def count_slow(mask):
    left, n = set(zip(*np.nonzero(mask))), 0
    while left:
        n += 1
        queue = [left.pop()]
        while queue:
            y, x = queue.pop()
            near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & left
            left -= near
            queue += near
    return n


@pytest.mark.parametrize("seed", range(6))
def test_canny_and_objects(seed):
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(np.cumsum(rng.normal(0, 6, (4, 13, 17)), axis=1), axis=2)
    gray = np.clip(128 + smooth, 0, 255).astype(np.uint8)
    gray[0] = rng.integers(0, 256, gray[0].shape)
    got = K.canny(gray, 60, 120)
    for i in range(4):
        want = canny_slow(gray[i], 60, 120)
        np.testing.assert_array_equal(got[i], want)
    stack = K.Stack(gray[:, None].astype(np.float32), {"object-count": {"low": 60, "high": 120}})
    for i, n in enumerate(K.object_count(stack)):
        grown = np.zeros((13, 17), bool)
        for y, x in zip(*np.nonzero(got[i])):
            grown[max(y - 1, 0):y + 2, max(x - 1, 0):x + 2] = True
        assert n == count_slow(grown)


def test_components_of_a_spiral():
    """A long thin path is one component."""
    mask = np.zeros((1, 21, 21), bool)
    y = x = 10
    step, length = 0, 2
    mask[0, y, x] = True
    while 0 < y < 20 and 0 < x < 20:
        for _ in range(2):
            for _ in range(length):
                y, x = y + (0, 1, 0, -1)[step % 4], x + (1, 0, -1, 0)[step % 4]
                if not (0 <= y < 21 and 0 <= x < 21):
                    break
                mask[0, y, x] = True
            step += 1
        length += 2
    label = K.components(mask)
    assert len(np.unique(label[mask])) == count_slow(mask[0])


# Wavelets ----------------------------------------------------------------------------------

def test_daubechies_filters():
    root = np.sqrt(3)
    want = np.array([1 + root, 3 + root, 3 - root, 1 - root]) / (4 * np.sqrt(2))
    np.testing.assert_allclose(K.daubechies(2), want, atol=1e-12)
    for order in range(1, 11):
        taps = K.daubechies(order)
        for shift in range(order):  # orthonormal to its even shifts
            dot = taps[2 * shift:] @ taps[:len(taps) - 2 * shift]
            assert abs(dot - (shift == 0)) < 1e-6
    with pytest.raises(ValueError):
        K.wavelet_filters("sym4")


def test_band_against_the_definition():
    x = np.random.default_rng(1).random(11)
    n = len(x)
    mirror = lambda k: x[-k - 1 if k < 0 else 2 * n - 1 - k if k >= n else k]
    for taps in K.wavelet_filters("db2"):
        want = [sum(f * mirror(2 * i + 1 - j) for j, f in enumerate(taps))
                for i in range((n + 3) // 2)]
        np.testing.assert_allclose(K.split_band(x[None, None], taps)[0, 0], want)


def test_levels_and_energy(spark):
    rng = np.random.default_rng(5)
    gray = rng.random((2, 32, 32))
    assert K.wavelet_levels(gray, "db2").shape == (2, 3)
    assert K.wavelet_levels(gray[:, :8, :8], "db2").shape == (2, 1)
    assert K.wavelet_levels(gray[:, :2, :2], "db2").shape == (2, 0)
    assert K.wavelet_levels(gray, "haar", level=2).shape == (2, 2)
    # Haar is orthonormal on even sizes: details plus the last approximation keep the energy
    whole = K.wavelet_levels(gray, "haar").sum(axis=1) + gray.sum(axis=(1, 2)) ** 2 / 1024
    np.testing.assert_allclose(whole, (gray ** 2).sum(axis=(1, 2)))
    table = K.wavelet_table(frame(spark, [g[None] for g in gray]), "db2").toPandas()
    scored = K.score_images(frame(spark, [g[None] for g in gray]),
                            ["wavelet-energy", "wavelet-entropy"]).toPandas()
    np.testing.assert_allclose(table["energy"], scored["wavelet-energy"], rtol=1e-5)
    np.testing.assert_allclose(table["entropy"], scored["wavelet-entropy"], rtol=1e-5)


# Failures, parameters, planes --------------------------------------------------------------

def test_failures_are_isolated(spark):
    good = np.random.default_rng(2).random((3, 8, 8))
    images = frame(spark, [good, np.random.default_rng(4).random((2, 8, 8))]).unionByName(
        spark.createDataFrame([(8, "x", "train", 3, 8, 8, [0.5]), (9, "x", "train", 3, 8, 8, None)],
                              IMAGE))
    rows = {r["index"]: r for r in K.score_images(images).collect()}
    assert not rows[0]["errors"] and rows[0]["edge-density"] is not None
    assert set(rows[1]["errors"]) == {"edge-density", "object-count"}
    assert rows[1]["color-variance"] is not None and rows[1]["edge-density"] is None
    for i in (8, 9):
        assert set(rows[i]["errors"]) == set(K.image_metric_ids())
        assert rows[i]["color-variance"] is None


def test_parameters_change_the_result(spark):
    images = frame(spark, [np.random.default_rng(6).random((1, 16, 16))])
    few = K.score_images(images, ["edge-density"], {"edge-density": {"low": 700, "high": 900}})
    many = K.score_images(images, ["edge-density"], {"edge-density": {"low": 10, "high": 20}})
    assert few.first()["edge-density"] < many.first()["edge-density"]


def test_bytes_are_clamped_and_truncated(spark):
    images = frame(spark, [np.array([[[-0.5, 0.999, 1.0]]]), np.array([[[300.0, 1.7, -3.0]]])])
    got = {r["index"]: r["b"] for r in
           images.select("index", IX.to_bytes(F.col("data")).alias("b")).collect()}
    assert got == {0: [0, 254, 255], 1: [255, 1, 0]}
    stacked = K.as_bytes(np.array([[[-0.5, 0.999, 1.0]], [[300.0, 1.7, -3.0]]], np.float32))
    assert stacked[:, 0].tolist() == [got[0], got[1]]
    every = np.arange(256, dtype=np.float32) / 255  # k/255 comes back as k
    assert K.as_bytes(every[None, None]).ravel().tolist() == list(range(256))


def test_sobel_relation_equals_kernel(spark):
    gray = np.random.default_rng(7).integers(2, 256, (1, 6, 5)).astype(float)
    gx, gy = K.sobel_stack(gray.astype(np.uint8))
    for r in M.sobel(frame(spark, [gray])).collect():
        assert (r["gx"], r["gy"]) == (gx[0, r["y"], r["x"]], gy[0, r["y"], r["x"]])


def test_prepare(spark):
    data = np.random.default_rng(1).random((1, 28, 28))
    row = SI.prepare(frame(spark, [data]), "mnist", seed=3).first()
    assert (row["h"], row["w"], len(row["data"])) == (32, 32, 1024)
    padded = np.full((36, 36), -1.0)
    padded[4:32, 4:32] = (data[0].astype(np.float32) - 0.5) / 0.5
    got = np.array(row["data"]).reshape(32, 32)
    assert any(np.allclose(got, padded[y:y + 32, x:x + 32], atol=1e-6)
               for y in range(5) for x in range(5))
    plain = SI.prepare(frame(spark, [data]), "mnist", train=False).first()
    np.testing.assert_allclose(plain["data"], ((data.astype(np.float32) - .5) / .5).ravel(),
                               atol=1e-6)


def test_augment_is_reproducible(spark):
    images = frame(spark, [np.random.default_rng(i).random((1, 6, 6)) for i in range(8)])
    first = {r["index"]: r["data"] for r in M.augment(images, 6, 2, seed=1).collect()}
    again = {r["index"]: r["data"] for r in M.augment(images.repartition(5), 6, 2, seed=1)
             .collect()}
    other = {r["index"]: r["data"] for r in M.augment(images, 6, 2, seed=2).collect()}
    assert first == again != other


# Files -------------------------------------------------------------------------------------

def write_png(path, pixels):
    """RGB or gray uint8 array as PNG."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, body: (struct.pack(">I", len(body)) + kind + body
                                + struct.pack(">I", zlib.crc32(kind + body)))
    header = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header)
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folders(spark, tmp_path):
    rng = np.random.default_rng(8)
    made = {}
    for split, label, name in (("train", "cat", "a"), ("train", "dog", "b"), ("test", "cat", "c"),
                               ("train", "cat", "d")):
        made[split, label, name] = rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)
        write_png(tmp_path / split / label / f"{name}.png", made[split, label, name])
    corpus = SI.load_corpus(spark, "cifar-10", str(tmp_path))
    rows = {(r["split"], r["index"]): r for r in corpus.collect()}
    assert [rows["train", i]["class"] for i in range(3)] == ["cat", "cat", "dog"]
    first = np.array(rows["train", 0]["data"]).reshape(3, 4, 5)
    np.testing.assert_allclose(first, made["train", "cat", "a"].transpose(2, 0, 1) / 255,
                               atol=1e-6)
    facts = {r["split"]: r for r in SI.corpus_facts(corpus).collect()}
    assert facts["train"]["size"] == 3 and facts["train"]["num_classes"] == 2
    assert (facts["test"]["channels"], facts["test"]["height"], facts["test"]["width"]) == (3, 4, 5)
    stored = SI.stored_compression(spark, str(tmp_path / "*" / "*")).collect()
    assert len(stored) == 4 and all(r["compression-ratio"] > 0 for r in stored)


def test_registered_entries():
    assert DATASETS.ids() == ["mnist", "cifar-10", "cifar-100", "imagenet"]
    assert DATASETS.ids(["rgb"]) == ["cifar-10", "cifar-100", "imagenet"]
    assert DATASETS.ids(["large-scale"]) == ["imagenet"]
    assert METRICS.ids(["wavelet-decomposition"]) == ["wavelet-energy", "wavelet-entropy"]
    import lehrplan.operators.history  # noqa: F401
    assert set(METRICS.ids(["model-informed"])) == {"convergence-time", "saturation-time"}


def test_score_dataset_resumes(spark):
    path = staging_path(spark, "resume")
    rng = np.random.default_rng(9)
    arrays = [rng.random((1, 8, 8)) for _ in range(6)]
    scoring.score_dataset(spark, frame(spark, arrays[:4]), path, "d", metrics=["color-variance"])
    table = scoring.score_dataset(spark, frame(spark, arrays), path, "d",
                                  metrics=["color-variance", "edge-density", "nonsense"])
    assert table.columns == ["index", "class", "color-variance", "edge-density"]
    whole = K.score_images(frame(spark, arrays), ["color-variance", "edge-density"])
    assert table.exceptAll(whole.drop("errors")).count() == 0 and table.count() == 6
    left = SC.pending(frame(spark, arrays), table, ["color-variance", "edge-density"])
    assert left.count() == 0


def test_stored_scores_and_errors(spark):
    """A stored score is not computed again; a failure is stored and tried again."""
    path = staging_path(spark, "errors")
    images = frame(spark, [np.random.default_rng(i).random((1, 6, 6)) for i in range(3)])
    broken = images.withColumn("data", F.when(F.col("index") != 1, F.col("data")))
    names = ["color-variance", "spatial-frequency"]
    first = scoring.score_dataset(spark, broken, path, "d", metrics=names[:1])
    SC.save_scores(first.withColumn(names[0], F.when(F.col("index") != 1, 123.0)), path, "d", 1)
    rows = {r["index"]: r for r in scoring.score_dataset(spark, broken, path, "d",
                                                         metrics=names).collect()}
    assert [rows[i][names[0]] for i in range(3)] == [123.0, None, 123.0]
    assert rows[0][names[1]] is not None and rows[1][names[1]] is None
    failed = SC.load_errors(spark, path, "d", 1)
    assert {(r["index"], r["metric"]) for r in failed.collect()} == {(1, n) for n in names}
    scoring.score_dataset(spark, images, path, "d", metrics=names)
    assert SC.load_errors(spark, path, "d", 1).count() == 0
    folder = SC.partition(path, "d", 1)
    done = SC.last_version(spark, folder)
    table = scoring.score_dataset(spark, images, path, "d", metrics=names)
    assert table.count() == 3 and SC.last_version(spark, folder) == done  # nothing was missing


def test_all_metrics_with_histories(spark):
    path = staging_path(spark, "nine")
    images = frame(spark, [np.random.default_rng(i).random((1, 8, 8)) for i in range(2)])
    history = spark.createDataFrame([(0, i, 1.0 / i) for i in range(1, 9)],
                                    "index long, iteration int, loss double")
    layers = spark.createDataFrame([(0, "a", i, 0.5 ** i) for i in range(1, 9)],
                                   "index long, layer string, iteration int, delta double")
    table = scoring.score_dataset(spark, images, path, "d", history=history, layer_history=layers)
    rows = {r["index"]: r for r in table.collect()}
    assert set(table.columns[2:]) == set(METRICS.ids()) and len(rows) == 2
    assert rows[0]["convergence-time"] == 8.0 and rows[1]["convergence-time"] is None
    again = scoring.score_dataset(spark, images, path, "d", metrics=["all"], history=history)
    assert again.exceptAll(table).count() == 0


def test_files_that_are_no_images(spark, tmp_path):
    write_png(tmp_path / "train" / "cat" / "a.png", np.full((4, 5, 3), 9, dtype=np.uint8))
    (tmp_path / "train" / "cat" / "b.png").write_bytes(b"no image")
    corpus = SI.load_corpus(spark, "cifar-10", str(tmp_path))
    rows = {r["index"]: r for r in K.score_images(corpus, ["color-variance"]).collect()}
    assert rows[0]["color-variance"] == 0.0 and not rows[0]["errors"]
    assert rows[1]["color-variance"] is None and rows[1]["errors"]
    facts = SI.corpus_facts(corpus).first()
    assert (facts["size"], facts["channels"], facts["height"], facts["width"]) == (2, 3, 4, 5)


def test_score_sample(spark):
    images = frame(spark, [np.ones((3, 8, 8)), np.ones((2, 8, 8))])
    text = scoring.score_sample(images, 1, ["color-variance", "edge-density"]).first()["report"]
    report = json.loads(text)
    assert report["color-variance"] == 0.0 and "luma needs" in report["edge-density"]
    text = scoring.score_sample(images, 0, ["color-variance", "edge-density"]).first()["report"]
    assert json.loads(text) == {"color-variance": 0.0, "edge-density": 0.0}


def test_metrics_of_other_kinds_are_reported(caplog):
    assert scoring.requested_metrics(["convergence-time", "edge-density"]) == ["edge-density"]
    assert "convergence-time" in caplog.text


def test_prepared_images_are_made_in_bounded_pieces(spark, monkeypatch):
    """A crop much larger than its image counts by what it becomes; pieces change no value."""
    import pyarrow as pa

    lists = pa.array([[1.0] * 12, None, [2.0] * 12] * 700, type=pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2100)), lists], names=["index", "data"])
    made = np.full(2100, 3 * 32 * 32)
    parts = list(K.pieces(batch, made))
    assert len(parts) > 1 and max(p.num_rows for p in parts) * 3 * 32 * 32 <= K.FEED_VALUES + 3 * 32 * 32
    assert pa.Table.from_batches(parts).column("index").to_pylist() == list(range(2100))
    assert list(K.pieces(batch.slice(0, 0), made[:0])) == [batch.slice(0, 0)]

    rows = [(i, 3, 2, 2, None if i == 4 else [float(i + k) for k in range(12)]) for i in range(40)]
    df = spark.createDataFrame(rows, "index long, c int, h int, w int, data array<float>").coalesce(1)
    run = lambda: {r["index"]: r["data"] for r in K.feed(df, 8, 4, True, seed=3).collect()}
    want = run()
    monkeypatch.setattr(K, "FEED_VALUES", 500)
    assert run() == want and want[4] is None and len(want[0]) == 3 * 8 * 8


def test_corpus_lists_folders(spark, tmp_path, monkeypatch):
    """Files are no paths of their own for the reader; a file beside the class folders is left out."""
    for i, place in enumerate(["train/cat", "train/dog", "test/cat", "train"]):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / f"{i}.png").write_bytes(b"no image")
    seen, reader = [], type(spark.read)
    load = reader.load
    monkeypatch.setattr(reader, "load", lambda self, path=None, *a, **k: (seen.append(path), load(self, path, *a, **k))[1])
    rows = SI.read_corpus(spark, str(tmp_path)).collect()
    assert sorted((r["split"], r["class"], r["index"]) for r in rows) == [
        ("test", "cat", 0), ("train", "cat", 0), ("train", "dog", 1)]
    assert seen == [f"{tmp_path}/*/*"] * 2
