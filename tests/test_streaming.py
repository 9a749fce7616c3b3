from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lehrplan.operators import distributions as D, image_kernels as K, schedules as S
from lehrplan.sources.staging import staging_path
from lehrplan.streaming import (distributions as SD, orders as SO, pacing as SP, quantiles as SQ,
                                scoring as SS)
from tests.test_images import IMAGE, frame

EPOCHS = 12


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("a", 30), ("b", 12)], "run string, total_batches int")


def reports(epochs):
    rng = np.random.default_rng(0)
    rows = [(run, e, b, float(rng.random() / e + .1), float(rng.random()), None, None)
            for e in range(1, EPOCHS + 1) for run in "ab" for b in range(6)
            if rng.random() > 0.15]
    rows += [(run, e, None, None, None, 2.0 / e, min(.9, e / 10))
             for e in range(1, EPOCHS + 1) for run in "ab"]
    return [r for r in rows if r[1] in epochs]


def run_waves(spark, runs, waves):
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    for wave in waves:
        spark.createDataFrame(wave, SP.TELEMETRY).coalesce(1).write.mode("append").parquet(land)
        SP.pacing_stream(spark.readStream.schema(SP.TELEMETRY).parquet(land), runs, EPOCHS, out,
                         mark).awaitTermination()
    counts = {(r["run"], r["epoch"]): r["n_active"]
              for r in spark.read.parquet(f"{out}/orders").collect()}
    late = spark.read.parquet(f"{out}/steps").agg(F.sum("late")).first()[0]
    return counts, late


def test_pacing_equals_batch(spark, runs):
    everything = spark.createDataFrame(reports(range(1, EPOCHS + 1)), SP.TELEMETRY)
    signals = everything.where("batch_idx is not null")
    epochs = everything.where("batch_idx is null").select("run", "epoch", "loss", "val_acc")
    want = {(r["run"], r["epoch"]): r["n_active"]
            for r in S.adaptive(runs, EPOCHS, epochs, signals).collect()}
    waves = [reports(range(1, 4)), reports(range(4, 10)), reports(range(10, EPOCHS + 1))]
    got, late = run_waves(spark, runs, waves)
    assert got == want and late == 0


def test_late_reports(spark, runs):
    """A report behind its batch is dropped and counted; closed epochs keep their order."""
    first, second = reports(range(1, 6)), reports(range(6, 9))
    stale = [("a", 2, 0, 5.0, 5.0, None, None)]
    plain, _ = run_waves(spark, runs, [first, second])
    got, late = run_waves(spark, runs, [first, second + stale])
    assert late == 1 and got == plain
    # a batch reporting for the first time, for an epoch already closed: counts from now on
    fresh = [("a", 3, 9, 5.0, 5.0, None, None)]
    later, late = run_waves(spark, runs, [first, second + fresh])
    assert late == 0
    assert {k: v for k, v in later.items() if k[1] <= 5} == \
        {k: v for k, v in plain.items() if k[1] <= 5}


def test_scoring_each_sample_once(spark):
    arrays = [np.random.default_rng(i).random((1, 6, 6)) for i in range(7)]
    images = frame(spark, arrays)
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    for low, high in ((0, 4), (2, 7)):  # the second wave repeats two samples
        images.where(F.col("index").between(low, high - 1)).write.mode("append").parquet(land)
        SS.score_stream(spark.readStream.schema(IMAGE).parquet(land), out, mark,
                        ["color-variance"]).awaitTermination()
    got = SS.read_log(spark, out, ["color-variance"])
    want = K.score_images(images, ["color-variance"]).drop("errors")
    assert got.count() == 7 and got.exceptAll(want).count() == 0


def test_scoring_reads_nothing_of_the_log(spark):
    """A log that is gone, or full of other rows, changes nothing: the state knows what was met; and a
    micro-batch with an index twice logs it once."""
    arrays = [np.random.default_rng(i).random((1, 6, 6)) for i in range(6)]
    images = frame(spark, arrays)
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    stream = lambda: spark.readStream.schema(IMAGE).parquet(land)
    twice = images.where("index < 4").unionByName(images.where("index = 2"))
    twice.coalesce(1).write.mode("append").parquet(land)
    SS.score_stream(stream(), out, mark, ["color-variance"], partitions=4).awaitTermination()
    assert sorted(r["index"] for r in SS.read_log(spark, out, ["color-variance"]).collect()) == [0, 1, 2, 3]
    other = staging_path(spark, "moved")
    images.write.mode("append").parquet(land)
    SS.score_stream(stream(), other, mark, ["color-variance"]).awaitTermination()
    assert sorted(r["index"] for r in SS.read_log(spark, other, ["color-variance"]).collect()) == [4, 5]


def test_failed_samples_are_logged_once(spark):
    images = frame(spark, [np.random.default_rng(i).random((1, 6, 6)) for i in range(3)])
    broken = images.withColumn("data", F.when(F.col("index") == 1, F.slice("data", 1, 5))
                               .otherwise(F.col("data")))
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    for _ in range(2):  # the second wave repeats all samples
        broken.write.mode("append").parquet(land)
        SS.score_stream(spark.readStream.schema(IMAGE).parquet(land), out, mark,
                        ["color-variance"]).awaitTermination()
    got = {r["index"]: r for r in SS.read_log(spark, out, ["color-variance"], errors=True).collect()}
    assert SS.read_log(spark, out, ["color-variance"]).count() == len(got) == 3
    assert got[1]["color-variance"] is None and "color-variance" in got[1]["errors"]
    assert got[0]["color-variance"] is not None and not got[0]["errors"]
    with pytest.raises(ValueError, match="edge-density"):
        SS.score_stream(spark.readStream.schema(IMAGE).parquet(land), out, mark, ["edge-density"])


def test_running_distributions(spark, scores):
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    for part in ("index < 9", "index >= 9"):
        scores.where(part).write.mode("append").parquet(land)
        SD.distribution_stream(spark.readStream.schema(scores.schema).parquet(land),
                               ["edge-density"], out, mark).awaitTermination()
    got = SD.latest_distributions(spark, out).toPandas().sort_values("scope").reset_index(drop=True)
    want = D.distributions(scores, ["edge-density"]).toPandas().sort_values("scope")
    for c in ("count", "mean", "maximum", "minimum", "std"):
        np.testing.assert_allclose(got[c], want[c])


DAY = 86_400
CLOCKED = "ts timestamp, run string, epoch int, batch_idx int, gain double"


def clocked(rows):
    """Reports at a second of their epoch's day; a row of None tells the time alone."""
    return [(datetime.fromtimestamp(s, timezone.utc), *rest) for s, *rest in rows]


def run_orders(spark, runs, waves, delay, **options):
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    ends = F.timestamp_seconds((F.col("epoch") + 1) * DAY)
    for wave in waves:
        spark.createDataFrame(clocked(wave), CLOCKED).coalesce(1).write.mode("append").parquet(land)
        SO.order_stream(spark.readStream.schema(CLOCKED).parquet(land), runs, "gain", ends, out, mark,
                        delay=delay, digits=9, **options).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{out}/orders").drop("part").collect()))


def test_order_stream_equals_batch(spark, runs):
    """Three starts, reports out of order, some a wave late: those the watermark still lets in count,
    the others are dropped; an epoch closes without a summary, also where blocks were silent."""
    draw = np.random.default_rng(8)
    reports_ = [(e * DAY + b, run, e, b, float(draw.random())) for e in range(1, EPOCHS + 1) for run in "ab"
                for b in range(0, 12) if draw.random() > 0.3 and not (b > 7 and e in (3, 4, 9))]
    early = [r for r in reports_ if r[2] <= 5 and r[3] != 2]
    late = [r for r in reports_ if r[2] in (4, 5) and r[3] == 2]       # within two days: counts
    lost = [r for r in reports_ if r[2] <= 3 and r[3] == 2]            # older than the watermark
    rest = [r for r in reports_ if r[2] > 5]
    time = lambda day: [(day * DAY, None, None, None, None)]
    draw.shuffle(rest)
    half = [r for r in rest if r[2] <= 9]
    got = run_orders(spark, runs, [early + time(6), late + lost + half + time(10),
                                   [r for r in rest if r[2] > 9] + time(40)], "2 days", block=5)
    kept = spark.createDataFrame([r[1:] for r in early + late + rest],
                                 "run string, epoch int, batch_idx int, gain double")
    want = S.signal_order(runs, EPOCHS, kept, "gain", digits=9)
    shown = {(r["run"], r["epoch"]) for r in kept.select("run", "epoch").distinct().collect()}
    assert got == sorted(tuple(r) for r in want.select("run", "epoch", "slot", "batch_idx").collect()
                         if (r["run"], r["epoch"]) in shown)


def test_open_epochs_wait(spark, runs):
    rows = [(DAY * e + 5, "a", e, b, 1.0 + b) for e in (1, 2) for b in range(3)]
    got = run_orders(spark, runs, [rows], "0 seconds")
    assert {r[1] for r in got} == {1}  # the second epoch has not ended


def test_quantile_sketches(spark):
    """Sketches of waves and merged ones stay within the stated rank error; ties count as one range."""
    draw = np.random.default_rng(4)
    frame = pd.DataFrame({"index": range(30_000), "class": draw.choice(["x", "y", None], 30_000),
                          "m": np.where(draw.random(30_000) < 0.3, 5.0, draw.lognormal(1, 2, 30_000))})
    frame.loc[::11, "m"] = np.nan
    table = spark.createDataFrame(frame).withColumn("m", F.nanvl("m", F.lit(None).cast("double")))
    land, out, mark = (staging_path(spark, n) for n in ("land", "out", "marks"))
    for part in ("index % 2 = 0", "index % 2 = 1"):
        table.where(part).write.mode("append").parquet(land)
        SQ.quantile_stream(spark.readStream.schema(table.schema).parquet(land), ["m"], out,
                           mark).awaitTermination()
    streamed = SQ.latest_sketches(spark, out)
    merged = SQ.merged_sketches(*[SQ.quantile_sketches(table.where(f"index % 3 = {i}"), ["m"]) for i in range(3)])
    want = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    for sketches in (streamed, merged):
        rows = {r["scope"]: r for r in SQ.sketch_quantiles(sketches, want).collect()}
        assert set(rows) == {"global", "x", "y"}
        for scope, r in rows.items():
            values = frame["m"] if scope == "global" else frame.loc[frame["class"] == scope, "m"]
            values = values.dropna().to_numpy()
            assert r["count"] == len(values)
            for name, q in want.items():
                assert (values < r[name]).sum() <= (q + SQ.RANK_ERROR) * len(values)
                assert (values <= r[name]).sum() >= (q - SQ.RANK_ERROR) * len(values)
