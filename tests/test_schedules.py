import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lehrplan.operators import schedules as S, signals as G
from lehrplan.plans import training
from lehrplan.registry import SCHEDULES

EPOCHS = 14


@pytest.fixture(scope="module")
def telemetry(spark):
    """Two runs; some batches report late, fall silent, or never report."""
    rng = np.random.default_rng(11)
    epochs, signals = [], []
    for run in ("a", "b"):
        for e in range(1, EPOCHS + 1):
            loss = None if (run, e) == ("b", 6) else float(2 / e + rng.normal(0, 0.02))
            epochs.append((run, e, loss, float(min(0.9, 0.1 * e))))
            for b in range(9):
                if b == 3 or (b == 5 and e < 4) or rng.random() < 0.2:
                    continue
                flat = 1.0 if b == 7 else float(rng.random() / e + 0.2)
                signals.append((run, e, b, flat, float(rng.random()), float(rng.random())))
    return (spark.createDataFrame(epochs, "run string, epoch int, loss double, val_acc double"),
            spark.createDataFrame(signals, "run string, epoch int, batch_idx int, "
                                  "mean_std double, mean_grad_norm double, mean_entropy double"))


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("a", 40), ("b", 11)], "run string, total_batches int")


# One run at a time, over whole series -------------------------------------------------------

def logistic(x):
    return 1 / (1 + np.exp(-x))


def flatness(values, w):
    """Plateau score of a batch after each of its reports."""
    own = pd.Series(values, dtype=float)
    spread = lambda windows: windows.std(ddof=0) / (windows.mean().abs() + 1e-8)
    whole, recent = spread(own.expanding()), spread(own.rolling(w))
    score = (1 - recent / whole.where(whole >= 1e-8)).clip(lower=0).where(whole >= 1e-8, 1.0)
    return score.where(own.expanding().count() >= w + 2, 0.0)


def adaptive_series(total, epochs, signals, w, f0):
    """(epoch, active, scores, readiness) of a run, from rolling series."""
    days = range(1, EPOCHS + 1)
    loss = pd.Series({e: epochs[e][0] for e in days}, dtype=float).dropna()
    smooth = loss.rolling(w).mean()
    fall = logistic(10 * (smooth / smooth.shift(w) - 1)).reindex(days).ffill().fillna(0.0)
    acc = pd.Series({e: epochs[e][1] for e in days}, dtype=float)
    centred = np.arange(w) - (w - 1) / 2
    slope = acc.rolling(w).apply(lambda v: centred @ v / (centred @ centred), raw=True)
    noise = acc.rolling(w).std(ddof=0)
    trend = logistic(-5 * slope / noise).where(noise >= 1e-8, 1.0).where(slope.notna(), 0.0)
    parts = [fall, trend]
    for name in ("mean_std", "mean_grad_norm"):
        seen = {}
        for e, batches in signals.items():
            for b, row in batches.items():
                seen.setdefault(b, {})[e] = row[name]
        columns = {}
        for b, values in seen.items():
            order = sorted(values)
            columns[b] = pd.Series(flatness([values[e] for e in order], w).to_numpy(), index=order)
        parts.append(pd.DataFrame(columns).reindex(days).ffill().mean(axis=1).fillna(0.0))
    table = pd.concat(parts, axis=1).to_numpy()
    ready = table.mean(axis=1)

    def grow(active, e):
        left = total - active
        if not left:
            return active
        least = max(1, math.ceil(left / (EPOCHS - e))) if e < EPOCHS else left
        return active + max(1, min(left, int(least + ready[e - 1] * (min(left, 3 * least) - least))))

    active = list(accumulate(days, grow, initial=max(1, int(total * f0))))[1:]
    return list(zip(days, active, table.tolist(), ready))


def by_run(telemetry, run):
    epochs = {r["epoch"]: (r["loss"], r["val_acc"]) for r in telemetry[0].collect()
              if r["run"] == run}
    signals = {}
    for r in telemetry[1].collect():
        if r["run"] == run:
            signals.setdefault(r["epoch"], {})[r["batch_idx"]] = r.asDict()
    return epochs, signals


@pytest.mark.parametrize("window,f0", [(5, 0.3), (3, 0.05)])
def test_adaptive(telemetry, runs, window, f0):
    got = {(r["run"], r["epoch"]): r["n_active"] for r in S.adaptive(
        runs, EPOCHS, telemetry[0], telemetry[1], f0, window).collect()}
    ready = {(r["run"], r["epoch"]): r for r in
             G.readiness(telemetry[0], telemetry[1], window).collect()}
    for run, total in (("a", 40), ("b", 11)):
        for e, active, parts, want in adaptive_series(total, *by_run(telemetry, run), window, f0):
            row = ready[run, e]
            np.testing.assert_allclose(
                [row["r_loss"], row["r_val"], row["r_act"], row["r_grad"]], parts, atol=1e-9)
            assert got[run, e] == active
        assert got[run, EPOCHS] == total


def test_linear(spark, runs):
    got = {(r["run"], r["epoch"]): r["n_active"] for r in S.linear(runs, 20).collect()}
    for run, total in (("a", 40), ("b", 11)):
        for e in range(1, 21):
            want = total if e >= 12 else max(1, int((0.3 + (1.0 - 0.3) * (e / 12)) * total))
            assert got[run, e] == want


@pytest.mark.parametrize("options", [{"start_fraction": 0.0}, {"start_fraction": 1.0},
                                     {"full_data_epoch": 0}, {"full_data_epoch": 21}])
def test_linear_rejects(runs, options):
    with pytest.raises(ValueError):
        S.linear(runs, 20, **options)


@pytest.mark.parametrize("id,column", [("gradient", "mean_grad_norm"),
                                       ("uncertainty", "mean_entropy")])
def test_signal_orders(telemetry, runs, id, column):
    order = S.schedule(id, runs, EPOCHS, signals=telemetry[1], smooth_window=4,
                       cold_start_epochs=2).toPandas()
    for run, total in (("a", 40), ("b", 11)):
        _, signals = by_run(telemetry, run)
        seen = {}
        for e in range(1, EPOCHS + 1):
            for b, row in signals.get(e, {}).items():
                seen.setdefault(b, []).append(row[column])
            means = [np.mean(seen[b]) if b in seen else 0.0 for b in range(total)]
            smooth = [np.mean(means[max(0, i - 2):i + 3]) for i in range(total)]
            want = list(range(total)) if e <= 2 else sorted(
                range(total), key=lambda i: round(smooth[i], 9), reverse=True)
            part = order[(order.run == run) & (order.epoch == e)].sort_values("slot")
            assert part["batch_idx"].tolist() == want


def test_no_history_is_natural_order(runs, telemetry):
    order = S.schedule("gradient", runs, 3, signals=telemetry[1].limit(0)).toPandas()
    assert (order["slot"] == order["batch_idx"]).all() and len(order) == 3 * 51


def test_smoothing_across_blocks(spark):
    rng = np.random.default_rng(0)
    values = rng.random(50)
    rows = spark.createDataFrame([("r", 1, i, float(v)) for i, v in enumerate(values)],
                                 "run string, epoch int, batch_idx int, v double")
    for block in (7, 4096):
        got = G.smooth_centered(rows, "v", "s", 3, block=block).toPandas().sort_values("batch_idx")
        want = [values[max(0, i - 3):i + 4].mean() for i in range(50)]
        np.testing.assert_allclose(got["s"], want)


def test_exposure_is_shifted(runs):
    counts = S.linear(runs, 10)
    shown = {(r["run"], r["epoch"]): r["n_active"] for r in
             S.exposure_counts(counts, runs, 10).collect()}
    order = {(r["run"], r["epoch"]): r["n_active"] for r in counts.collect()}
    assert shown["a", 1] == 40 and all(shown["a", e] == order["a", e - 1] for e in range(2, 11))
    full = S.exposure(S.prefix_order(counts), runs, 10).groupBy("run", "epoch").count().collect()
    assert {(r["run"], r["epoch"]): r["count"] for r in full} == shown
    stats = S.exposure_statistics(S.exposure_counts(counts, runs, 10), runs, 10).toPandas()
    a = stats[stats.run == "a"].sort_values("epoch")
    assert a["cumulative_batches"].iloc[-1] == sum(v for (r, _), v in shown.items() if r == "a")
    assert a["dsi"].iloc[0] == round(1 - a["cumulative_batches"].iloc[-1] / 400, 4)


def test_registered():
    assert SCHEDULES.ids(["pacing"]) == ["linear", "adaptive", "gradient", "uncertainty"]
    assert SCHEDULES.ids(["adaptive"]) == ["adaptive", "gradient", "uncertainty"]


def test_sequences_agree(spark, scores, telemetry):
    """The shuffle-free forms against the sort of every sample of every epoch."""
    from lehrplan.operators import curriculum as C
    cut = C.holistic(scores, "ascending", "edge-density", 3)  # 7 batches, the last of 2
    runs = spark.createDataFrame([("a", 7)], "run string, total_batches int")
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    counts = S.linear(runs, 6)
    assert same(C.prefix_sequence(counts, cut, 3),
                C.sequence(S.prefix_order(counts).drop("run"), cut))
    order = S.schedule("gradient", runs, 6, signals=telemetry[1].where("run = 'a'")).drop("run")
    assert same(C.permuted_sequence(order, cut, 3), C.sequence(order, cut))


def test_paced_samples(scores, spark):
    plan = training.Settings("d", epochs=5, batch_size=6, metric="edge-density",
                             schedule="linear")
    rows = training.paced_samples(scores, plan).toPandas()
    sizes = rows.groupby("epoch").size().tolist()
    assert sizes[0] == 24 and sizes[-1] == 24 and min(sizes) >= 6
    value = {r["index"]: r["edge-density"] for r in scores.collect()}
    for _, g in rows.groupby("epoch"):
        g = g.sort_values("position")
        assert g["position"].tolist() == list(range(len(g)))
        assert g["index"].map(value).is_monotonic_increasing
    base = training.paced_samples(scores, training.Settings("d", epochs=2, batch_size=6))
    assert base.toPandas().sort_values(["epoch", "position"])["index"].tolist() == [*range(24)] * 2
    even = training.batches(scores, training.Settings(
        "d", epochs=1, batch_size=4, metric="edge-density", normalize_classes=True))
    classes = even.join(scores, "index").groupBy("batch_idx").agg(F.count_distinct("class")
                                                                  .alias("n")).collect()
    assert all(r["n"] == 4 for r in classes)


def test_telemetry_of_the_right_run(spark, scores):
    """The run is named, or the only one; a missing run or epoch is an error, not a gap."""
    epochs = spark.createDataFrame([(r, e, 2.0 / e, 0.1 * e) for r in ("r1", "r2") for e in range(1, 7)],
                                   "run string, epoch int, loss double, val_acc double")
    signals = spark.createDataFrame([(r, e, b, 1.0 / e, 0.5, 0.2 * b) for r in ("r1", "r2") for e in range(1, 7)
                                     for b in range(4)], "run string, epoch int, batch_idx int, mean_std double, "
                                                         "mean_grad_norm double, mean_entropy double")
    def plan(schedule, **more):
        return training.Settings("d", epochs=6, batch_size=6, metric="edge-density", schedule=schedule, **more)

    only = [t.where("run = 'r1'") for t in (epochs, signals)]
    for schedule in ("adaptive", "gradient", "uncertainty"):
        named = training.paced_samples(scores, plan(schedule, run="r1"), epochs, signals)
        alone = training.paced_samples(scores, plan(schedule), *only)
        assert {r["epoch"] for r in named.collect()} == set(range(1, 7))
        assert named.exceptAll(alone).count() == 0 and alone.exceptAll(named).count() == 0
        with pytest.raises(ValueError, match="several"):
            training.paced_samples(scores, plan(schedule), epochs, signals)
        with pytest.raises(ValueError, match="no run 'r9'"):
            training.paced_samples(scores, plan(schedule, run="r9"), epochs, signals)
        with pytest.raises(ValueError, match="needs telemetry"):
            training.paced_samples(scores, plan(schedule))
    with pytest.raises(ValueError, match="epochs \\[4\\]"):
        training.paced_samples(scores, plan("adaptive"), only[0].where("epoch <> 3"), only[1])
