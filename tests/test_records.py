"""Histories, telemetry, run records."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lehrplan.operators import history as H, runs as R, telemetry as TM
from lehrplan.plans import training
from lehrplan.sources import reports
from lehrplan.sources.staging import staging_path

FLAT = "run string, epoch int, train_acc double, train_loss double, val_acc double, " \
       "val_loss double, batches int"


def convergence(losses, threshold, window, cap):
    """Fit until the loss stays put: (iterations, converged, final loss)."""
    stable, previous = 0, None
    for i, loss in enumerate(losses[:cap], 1):
        if previous is not None:
            stable = stable + 1 if abs(loss - previous) < threshold else 0
            if stable >= window:
                return float(i), True, loss
        previous = loss
    return float(min(len(losses), cap)), False, losses[min(len(losses), cap) - 1]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0.0, 0.05, 0.5, 0.52, 1.0]), min_size=1, max_size=25),
                min_size=1, max_size=8), st.integers(1, 4))
def test_convergence(spark, series, window):
    rows = [(i, t, float(v)) for i, s in enumerate(series) for t, v in enumerate(s, 1)]
    df = spark.createDataFrame(rows, "index long, iteration int, loss double")
    got = {r["index"]: tuple(r)[1:] for r in
           H.convergence_time(df, 0.1, window, 20).collect()}
    assert got == {i: convergence(s, 0.1, window, 20) for i, s in enumerate(series)}


def test_minimum_is_window_plus_one(spark):
    df = spark.createDataFrame([(0, t, 1.0) for t in range(1, 30)],
                               "index long, iteration int, loss double")
    assert H.convergence_time(df, 1e-3, 5).first()["value"] == 6.0
    series = H.histories(df, 1e-3, 5).first()
    assert len(series["loss_history"]) == 6 and len(series["loss_delta_history"]) == 5


def test_saturation(spark):
    quick, slow, never = [9, .1, .1, .1, 9], [.1, .1, 9, .1, .1, .1], [9.0] * 6
    rows = [(s, layer, t, float(d)) for s, layers in
            ((0, {"a": quick, "b": slow}), (1, {"a": quick, "b": never}))
            for layer, ds in layers.items() for t, d in enumerate(ds, 1)]
    df = spark.createDataFrame(rows, "index long, layer string, iteration int, delta double")
    layers = {(r["index"], r["layer"]): r["start"] for r in H.layer_saturation(df, 1, 3).collect()}
    assert layers == {(0, "a"): 2, (0, "b"): 4, (1, "a"): 2, (1, "b"): -1}
    got = {r["index"]: (r["value"], r["saturated"]) for r in H.saturation_time(df, 1, 3).collect()}
    assert got == {0: (6.0, True), 1: (6.0, False)}
    series = {(r["index"], r["layer"]): r["weight_delta_history"]
              for r in H.layer_histories(df, 1, 3).collect()}
    assert series[0, "a"] == quick[:4] and series[0, "b"] == slow and series[1, "b"] == never


def test_weight_deltas(spark):
    w = np.random.default_rng(0).random((3, 4))
    df = spark.createDataFrame([(0, "l", t, [float(v) for v in w[t]]) for t in range(3)],
                               "index long, layer string, iteration int, weights array<double>")
    got = [r["delta"] for r in H.weight_deltas(df).orderBy("iteration").collect()]
    np.testing.assert_allclose(got, np.linalg.norm(np.diff(w, axis=0), axis=1))


def test_logits(spark):
    rng = np.random.default_rng(1)
    z, y = rng.normal(0, 3, (12, 5)), rng.integers(0, 5, 12)
    z[0] = [0, 0, 900, 0, 900]  # saturated softmax: one-sided probabilities, first maximum wins
    rows = [(i, "r", 1, i // 4, [float(v) for v in z[i]], int(y[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "index long, run string, epoch int, batch_idx int, "
                               "logits array<double>, target int")
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        logp = np.maximum(np.log(p), -1e9)
    ce = -(z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(
        1, keepdims=True)))[np.arange(12), y]
    out = TM.sample_outcomes(df).toPandas().sort_values("index")
    np.testing.assert_allclose(out["cross_entropy"], ce, atol=1e-9)
    np.testing.assert_allclose(out["entropy"], -(p * logp).sum(1), atol=1e-9)
    assert out["predicted"].tolist() == z.argmax(1).tolist()
    epoch = TM.epoch_metrics(df).first()
    assert epoch["loss"] == pytest.approx(ce.reshape(3, 4).mean(1).mean(), abs=1e-4)
    assert epoch["accuracy"] == pytest.approx((z.argmax(1) == y).mean(), abs=1e-4)
    assert epoch["batches"] == 3


def test_batch_signals(spark):
    rows = [("r", 1, 0, "a", 3.0), ("r", 1, 0, "a", 4.0), ("r", 1, 0, "b", 0.0),
            ("r", 1, 0, "b", 2.0), ("r", 1, 1, "a", 1.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, batch_idx int, layer string, "
                               "value double")
    frame = TM.signal_frame(TM.batch_activation_std(df), TM.batch_grad_norm(df)).toPandas()
    frame = frame.sort_values("batch_idx")
    assert frame["mean_grad_norm"].tolist() == [3.5, 1.0]
    assert frame["mean_std"].iloc[0] == pytest.approx((np.sqrt(.5) + np.sqrt(2)) / 2)
    assert np.isnan(frame["mean_std"].iloc[1])


@pytest.fixture(scope="module")
def epochs(spark):
    rows = [("a", 1, .1, 3., .50, 2.0, 10), ("a", 2, .2, 2., .80, 1.0, 5),
            ("a", 3, .3, 1., .80, 0.5, None), ("b", 1, .1, 1., .30, 9.0, 10),
            ("c", 1, .1, 1., .30, 9.0, None)]
    return spark.createDataFrame(rows, FLAT)


@pytest.fixture(scope="module")
def configs(spark):
    rows = [("a", "net", "d", "cpu", 3, 1, False, False, "ascending", "m", "holistic", "linear",
             0.3, 10),
            ("b", "net", "d", "cpu", 3, 2, True, False, None, None, None, None, 0.3, 10),
            ("c", "net", "d", "cpu", 3, 3, False, False, None, None, None, None, 0.3, 0)]
    return spark.createDataFrame(
        rows, "run string, network string, dataset string, device string, epochs int, seed int, "
              "shuffled boolean, normalize_classes boolean, rank string, metric string, "
              "scope string, schedule string, start_fraction double, max_batches int")


def test_run_rows(epochs, configs):
    rows = {r["seed"]: r for r in R.run_rows(epochs, configs).collect()}
    assert R.run_rows(epochs, configs).columns == R.RUN_FIELDS
    a = rows[1]
    assert (a["best_epoch"], a["best_accuracy"], a["best_loss"]) == (2, .80, 1.0)  # first of ties
    assert (a["final_accuracy"], a["final_loss"]) == (.80, 0.5)
    assert a["dsi"] == 0.5 and a["total_batches_processed"] == 15
    assert rows[3]["dsi"] is None and rows[2]["rank"] is None
    assert a["record_file"] == f"records/net_d/{a['hash']}.json"


def test_append_is_idempotent(spark, epochs, configs):
    path = staging_path(spark, "runs")
    assert training.record_runs(spark, epochs, configs.where("run = 'a'"), path).count() == 1
    table = training.record_runs(spark, epochs, configs, path)
    assert table.count() == 3
    assert training.record_runs(spark, epochs, configs, path).count() == 3
    done = R.recorded(R.with_hash(configs), table)
    assert sorted(r["run"] for r in done.collect()) == ["a", "b", "c"]


def test_hash_depends_on_configuration_only(configs):
    hashes = {r["run"]: r["hash"] for r in R.with_hash(configs).collect()}
    assert len(set(hashes.values())) == 3
    moved = R.with_hash(configs.repartition(3)).collect()
    assert {r["run"]: r["hash"] for r in moved} == hashes
    for field, value in (("rank", "weighted"), ("metric", "other"), ("scope", "batch-wise"),
                         ("schedule", "gradient"), ("start_fraction", 0.77)):
        other = R.with_hash(configs.withColumn(field, F.lit(value))).collect()
        assert not {r["hash"] for r in other} & set(hashes.values()), field


def test_documents(spark, epochs, configs):
    docs = R.documents(epochs, R.run_rows(epochs, configs),
                       R.with_hash(configs).select("run", "hash"))
    path = staging_path(spark, "documents")
    reports.write_documents(docs, path)
    parsed = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    a = next(d for d in parsed if d["config"]["seed"] == 1)
    assert a["epochs"]["2"] == {"train": {"accuracy": .2, "loss": 2.0},
                                "validation": {"accuracy": .8, "loss": 1.0}, "batches": 5}
    assert a["results"]["best_epoch"] == 2 and a["dsi"] == 0.5


def test_recording_an_epoch_again_replaces_it(spark):
    rows = [("a", 1, 0, .1), ("a", 1, 5, .9), ("a", 2, 3, .4)]
    df = spark.createDataFrame(rows, "run string, epoch int, arrival long, acc double")
    got = {r["epoch"]: r["acc"] for r in R.upsert_epochs(df).collect()}
    assert got == {1: .9, 2: .4}


def test_compare_and_grid(spark, epochs, configs):
    rows = R.run_rows(epochs, configs)
    row = R.compare(rows, R.variant_of()).first()
    assert (row["baseline"], row["shuffled"], row["curriculum"]) == (.3, .3, .8)
    assert row["curriculum_gain"] == pytest.approx(.5)
    datasets = spark.createDataFrame([("x",), ("y",)], "dataset string")
    done = spark.createDataFrame([("x", "m1", "up")], "dataset string, model string, rank string")
    grid = R.experiment_grid(datasets, {"model": ["m1", "m2"], "rank": ["up", "down"]}, done)
    assert grid.count() == 7


@pytest.mark.parametrize("piece", [1, 4, 50, 1 << 16])
def test_series_in_pieces(spark, piece):
    """Pieces of a series give what one window over all of it gives: long runs over many pieces, gaps
    in the iterations, missing losses, several samples."""
    draw = np.random.default_rng(piece)
    rows = []
    for index in (0, 1, None):
        for i in range(400):
            if draw.random() < 0.9 and not (index == 1 and 100 <= i < 260):
                loss = None if draw.random() < 0.02 else float((draw.random() < 0.05) * draw.normal(0, 9))
                rows.append((index, i, loss))
    history = spark.createDataFrame(rows, "index long, iteration int, loss double")
    key = lambda r: (r["index"] is None, r["index"], r["iteration"])
    want = H.loss_deltas(history, max_iterations=400)
    got = H.loss_deltas(history, piece=piece)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    whole = H.stable_runs(want, "delta", ["index"], 2.0, longest=400)
    cut = H.stable_runs(want, "delta", ["index"], 2.0, piece=piece)
    assert cut.columns == whole.columns
    assert {key(r): r["stable_run"] for r in cut.collect()} == {key(r): r["stable_run"] for r in whole.collect()}
    chunks = H.history_chunks(history, 2.0, 30, piece=piece).collect()
    lists = {r["index"]: r for r in H.histories(history, 2.0, 30, max_iterations=400).collect()}
    joined = {}
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        assert len(r["loss_history"]) <= piece
        joined.setdefault(r["index"], ([], []))
        joined[r["index"]][0].extend(r["loss_history"])
        joined[r["index"]][1].extend(r["loss_delta_history"])
    assert joined == {i: (r["loss_history"], r["loss_delta_history"]) for i, r in lists.items()}


def test_long_series_is_spread(spark):
    """A window over rows is bounded by a piece: only the table of pieces is grouped by sample."""
    series = spark.range(1_000_000).select(
        F.lit(0).cast("long").alias("index"), F.col("id").alias("iteration"),
        F.when(F.col("id") % 300_000 == 7, 9.0).otherwise(0.0).alias("delta"))
    runs = H.stable_runs(series, "delta", ["index"], 1.0, piece=1 << 14)
    assert runs.agg(F.max("stable_run")).first()[0] == 299_999
    sizes = runs.groupBy(F.floor(F.col("iteration") / (1 << 14))).count().agg(F.max("count")).first()[0]
    assert sizes == 1 << 14
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    per_sample = [line for line in plan.splitlines() if "Window [" in line and "_piece" not in line]
    assert not per_sample, per_sample


def test_weight_delta_query_over_long_series(spark, tmp_path):
    """Layers with more iterations than its SQL looks at."""
    import __spark_entry__ as entry
    from tests.compare import check, connect

    draw = np.random.default_rng(21)
    rows = [(i, [float(v) for v in draw.normal(0, 1, 3)], 6) for i in range(4 * 1003)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(
        str(tmp_path / "written"))
    part, = (tmp_path / "written").glob("*.parquet")
    (tmp_path / "embeddings.parquet").write_bytes(part.read_bytes())
    assert check(spark, connect(str(tmp_path)), str(tmp_path), "h_weight_delta", entry.queries(),
                 entry.oracle_sql()) is None
