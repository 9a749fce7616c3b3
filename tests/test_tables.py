"""Score tables, distributions, caches and reports."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import lehrplan.operators.history  # noqa: F401
import lehrplan.operators.image_kernels  # noqa: F401
from lehrplan.functions.columns import metric_columns, numeric_columns
from lehrplan.operators import distributions as D
from lehrplan.operators.ranks import rank
from lehrplan.plans.analysis import analyze_scores
from lehrplan.registry import DuplicateEntry, METRICS, MissingEntry, Registry, tagged
from lehrplan.sources import commits, ranks as SR, reports, scores as SC
from lehrplan.sources.staging import staging_path
from tests.conftest import ranking, table

NAN = float("nan")


def test_init_has_every_metric(spark):
    fresh = SC.init_scores(5, spark=spark)
    assert fresh.columns == ["index", "class", *METRICS.ids()] and len(METRICS) == 9
    rows = fresh.collect()
    assert [r["index"] for r in rows] == list(range(5))
    assert all(r[m] is None for r in rows for m in fresh.columns[1:])


def test_save_and_load_one_partition(spark, scores):
    path = staging_path(spark, "scores")
    SC.save_scores(scores, path, "a", 1)
    SC.save_scores(scores.limit(3), path, "a", 2)
    SC.save_scores(scores.limit(5), path, "a", 2)   # replaces only (a, 2)
    SC.save_scores(SC.load_scores(spark, path, "a", 1).withColumn("extra", F.lit(1.0)),
                   path, "b", 1)
    assert SC.load_scores(spark, path, "a", 1).count() == 24
    assert SC.load_scores(spark, path, "a", 2).count() == 5
    assert all("dataset=a/seed=2" in f for f in SC.load_scores(spark, path, "a", 2).inputFiles())
    assert "extra" in metric_columns(SC.load_scores(spark, path, "b", 1))
    assert SC.load_scores(spark, path, "a", 1).columns == scores.columns
    with pytest.raises(ValueError):
        SC.save_scores(scores, path, "a/b", 1)


def values_of(df, metric):
    return {r["index"]: r[metric] for r in df.collect()}


def test_writes_that_break_off(spark, scores):
    """Folders without a record are invisible, with `_SUCCESS` files off as well."""
    path = staging_path(spark, "scores")
    key = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    spark.conf.set(key, "false")
    try:
        target = SC.save_scores(scores, path, "a", 1)
        commits.write_new(scores.limit(2), target, "scores")  # broke off before the record
        again = scores.withColumn("object-count", F.lit(1.0)).where("index < 5")
        commits.write_new(again.withColumn("object-count", F.lit(9.0)), target, "changes")
        assert SC.load_scores(spark, path, "a", 1).exceptAll(scores).count() == 0
        SC.save_changes(again.select("index", "class", "object-count"), path, "a", 1)
        SC.save_scores(scores.limit(3), path, "b", 1)
    finally:
        spark.conf.unset(key)
    got = values_of(SC.load_scores(spark, path, "a", 1), "object-count")
    old = values_of(scores, "object-count")
    assert got == {i: 1.0 if i < 5 else old[i] for i in old}
    assert SC.load_scores(spark, path, "b", 1).count() == 3
    assert SC.last_version(spark, target) == 2
    with pytest.raises(FileNotFoundError):
        SC.load_scores(spark, path, "c", 1)


def test_changes_are_merged(spark, scores):
    """New samples, new metrics, missing values, errors tried again, and a whole table after many."""
    path = staging_path(spark, "scores")
    first = scores.select("index", "class", "object-count").where("index < 20")
    SC.save_scores(first, path, "a", 1, spark.createDataFrame([(3, "x", "bad"), (4, "x", "bad")], SC.ERRORS))
    want = values_of(first, "object-count")
    for turn in range(SC.MOST_CHANGES + 1):
        rows = [(turn, None, float(turn)), (21, "w", float(turn)), (22, "w", None)]
        SC.save_changes(table(spark, rows, ["index", "class", "extra"]), path, "a", 1,
                        spark.createDataFrame([(turn, "x", None), (turn + 1, "x", "worse")], SC.ERRORS))
    got = {r["index"]: r for r in SC.load_scores(spark, path, "a", 1).collect()}
    assert set(got) == {*range(20), 21, 22}
    assert all(got[i]["object-count"] == v for i, v in want.items())
    assert got[2]["class"] == "w" and got[21]["extra"] == SC.MOST_CHANGES and got[22]["extra"] is None
    assert [got[i]["extra"] for i in range(SC.MOST_CHANGES + 1)] == [float(i) for i in range(SC.MOST_CHANGES + 1)]
    failed = {(r["index"], r["error"]) for r in SC.load_errors(spark, path, "a", 1).collect()}
    assert failed == {(SC.MOST_CHANGES + 1, "worse")}
    record = commits.last_record(spark, SC.partition(path, "a", 1), SC.VERSION)
    assert len(record["changes"]) < SC.MOST_CHANGES  # merged on the way
    before = values_of(SC.load_scores(spark, path, "a", 1), "extra")
    SC.compact(spark, path, "a", 1)
    assert values_of(SC.load_scores(spark, path, "a", 1), "extra") == before
    assert "," not in SC.scores_version(spark, path, "a", 1)


def test_two_writers_of_one_version(spark, scores, monkeypatch):
    path = staging_path(spark, "scores")
    SC.save_scores(scores, path, "a", 1)
    target = SC.partition(path, "a", 1)
    before = commits.last_record(spark, target, SC.VERSION)
    record = {k: before[k] for k in ("changes", "errors", "error_changes")}
    commits.publish(spark, target, SC.VERSION, version=2, id="0", scores=before["scores"], **record)
    with pytest.raises(RuntimeError, match="another writer"):  # its id sorts behind "0"
        commits.publish_next(spark, target, SC.VERSION, before, scores="lost", **record)
    assert SC.load_scores(spark, path, "a", 1).count() == 24


def test_csv_round_trip(spark, scores):
    path = staging_path(spark, "csv")
    scores.write.option("header", "true").csv(path)
    back = SC.read_scores_csv(spark, path, metric_columns(scores))
    assert back.count() == 24 and back.schema["edge-density"].dataType.typeName() == "double"


def test_point_lookup(scores):
    assert SC.score_value(scores, 3, "edge-density") == pytest.approx(
        {r["index"]: r["edge-density"] for r in scores.collect()}[3])
    with pytest.raises(KeyError):
        SC.score_value(scores, 3, "no-such")
    with pytest.raises(IndexError):
        SC.score_value(scores, 99, "edge-density")


def test_unscored_and_pending(spark):
    df = table(spark, [(0, "a", 1.0, NAN), (1, "a", None, 2.0), (2, "a", 1.0, 2.0)],
               ["index", "class", "x", "y"])
    ids = lambda d: sorted(r["index"] for r in d.collect())
    assert ids(SC.unscored(df, "x")) == [1] and ids(SC.unscored(df, "y")) == [0]
    assert ids(SC.unscored(df, "z")) == [0, 1, 2]
    samples = spark.range(5).toDF("index")
    assert ids(SC.pending(samples, df, ["x", "y"])) == [0, 1, 3, 4]
    assert ids(SC.pending(samples, df, ["z"])) == [0, 1, 2, 3, 4]


def test_upsert(spark):
    old = table(spark, [(0, None, 1.0), (1, "a", 5.0)], ["index", "class", "x"])
    new = table(spark, [(0, "b", None, 7.0), (2, "c", 3.0, 8.0)], ["index", "class", "x", "y"])
    rows = {r["index"]: (r["class"], r["x"], r["y"]) for r in SC.upsert(old, new).collect()}
    assert rows == {0: ("b", 1.0, 7.0), 1: ("a", 5.0, None), 2: ("c", 3.0, 8.0)}


def test_selection(scores):
    chosen = SC.select_metrics(scores, ["edge-density", "nope"])
    assert chosen.columns == ["index", "class", "edge-density"]
    assert SC.select_metrics(scores, ["all"]).columns == scores.columns
    assert METRICS.split(["edge-density", "nope"]) == (["edge-density"], ["nope"])
    assert numeric_columns(scores) == metric_columns(scores)


def test_registry(spark):
    r = Registry("things")
    r.register("a", tags=["x", "y"])(len)
    r.register("b", tags=["x"])(len)
    with pytest.raises(DuplicateEntry):
        r.register("a")(len)
    with pytest.raises(MissingEntry):
        r.get("c")
    assert "a" in r and "c" not in r and len(r) == 2 and list(r) == ["a", "b"]
    assert r.ids(["x"]) == ["a", "b"] and r.ids(["x", "y"]) == ["a"]
    names = lambda df: sorted(row["id"] for row in df.collect())
    assert names(tagged(r.frame(spark), ["x", "y"])) == ["a"]
    assert names(tagged(r.frame(spark), [])) == ["a", "b"]


# Distributions ------------------------------------------------------------------------------

def pandas_distribution(values):
    s = pd.Series(values, dtype=float)
    return [s.count(), s.mean(), s.max(), s.median(), s.min(), s.std(), s.quantile(.25),
            s.quantile(.5), s.quantile(.75)]


def assert_distributions(frame, got):
    names = ["count", "mean", "maximum", "median", "minimum", "std", "p25", "p50", "p75"]
    metrics = [c for c in frame.columns if c not in ("index", "class")]
    scopes = [("global", frame)] + list(frame.groupby("class"))
    assert len(got) == len(metrics) * len(scopes)
    for m in metrics:
        for scope, part in scopes:
            row = got[(got.metric == m) & (got.scope == scope)][names].astype(float).iloc[0]
            np.testing.assert_allclose(row, pandas_distribution(part[m]), rtol=1e-9, atol=1e-9)


def test_distributions(scores):
    assert_distributions(scores.toPandas(), D.distributions(scores).toPandas())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(
    st.none(), st.sampled_from([1.0, 2.0]), st.floats(-9, 9))), min_size=1, max_size=60))
def test_distributions_with_ties_and_gaps(spark, rows):
    df = table(spark, [(i, c, v) for i, (c, v) in enumerate(rows)], ["index", "class", "x"])
    frame = pd.DataFrame([(c, v) for c, v in rows], columns=["class", "x"])
    frame["x"] = frame["x"].astype(float)
    assert_distributions(frame, D.distributions(df).toPandas())


def test_ordered_bits(spark):
    """Every exponent, powers of two and their neighbours, subnormals, zeros and infinities."""
    tiny = np.nextafter(0, 1)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    draw = np.random.default_rng(6)
    some = draw.integers(0, 2047 << 52, 3000, dtype=np.int64).view(np.float64)
    values = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), some,
                             [0.0, -0.0, np.inf, tiny, np.finfo(float).max]])
    values = np.concatenate([values, -values])
    df = spark.createDataFrame(pd.DataFrame({"value": values}))
    got = D.with_ordered_bits(df, "value", "key").collect()
    for r in got:
        size = int(np.float64(abs(r["value"])).view(np.int64))
        assert r["key"] == (size if r["value"] > 0 else -size), r


@pytest.mark.parametrize("bits", [16, 8, 32])
@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_by_counting(spark, bits, seed):
    """Heavy ties, tiny classes, infinities, one value with a third of the rows, missing ones."""
    rng = np.random.default_rng(seed)
    n = 3000
    frame = pd.DataFrame({
        "class": np.where(np.arange(n) < 4, "rare", rng.choice(list("ab"), n)),
        "smooth": rng.normal(0, 1, n), "few": rng.integers(-2, 3, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.random(n) * 14),
        "wide": np.where(rng.random(n) < 0.3, -np.inf, np.ldexp(rng.random(n), rng.integers(-1060, 900, n))),
        "none": np.nan})
    frame.loc[rng.random(n) < 0.1, "smooth"] = np.nan
    rows = [(i, r[0], *[None if np.isnan(v) else float(v) for v in r[1:]])
            for i, r in enumerate(frame.itertuples(index=False))]
    df = table(spark, rows, ["index", "class", "smooth", "few", "hot", "wide", "none"])
    values = D.melt(df)
    by, at = ["metric", "class"], {"p01": .01, "p25": .25, "p50": .5, "p75": .75, "p100": 1.0}
    got = D.exact_quantiles(values, by, at, bits=bits).toPandas()
    want = values.groupBy(*by).agg(*[F.percentile("value", q).alias(k) for k, q in at.items()]).toPandas()
    assert len(got) == len(want) == 5 * 3
    merged = got.merge(want, on=by, suffixes=("", "_w"))
    for name in at:
        np.testing.assert_array_equal(merged[name], merged[f"{name}_w"])
    nothing = D.exact_quantiles(values.limit(0), by, at, bits=bits)
    assert nothing.count() == 0 and nothing.columns == [*by, *at]


def test_quantiles_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "class string, value double")
    got = {r["class"]: r["p50"] for r in D.exact_quantiles(df, ["class"], {"p50": 0.5}).collect()}
    assert got == {None: 2.0, "a": None, "b": 2.0}


def test_distribution_files(spark, scores):
    path = staging_path(spark, "distributions")
    analyze_scores(scores, path, ["edge-density"])
    back = spark.read.option("header", "true").csv(path)
    assert back.count() == 5 and "metric" in back.columns


# Rank cache and reports ----------------------------------------------------------------------

def test_rank_cache(spark, scores):
    path = staging_path(spark, "cache")
    keys = lambda: {r["rank_key"] for r in commits.records(spark, path, SR.ENTRY).collect()}
    first = SR.cached_rank(spark, path, scores, "ascending", "edge-density", "d")
    assert ranking(first) == ranking(rank(scores, "ascending", "edge-density"))
    assert ranking(SR.cached_rank(spark, path, scores.repartition(3), "ascending",
                                  "edge-density", "d")) == ranking(first)
    assert len(keys()) == 1
    changed = scores.withColumn("edge-density", -F.col("`edge-density`"))
    again = SR.cached_rank(spark, path, changed, "ascending", "edge-density", "d")
    assert ranking(again) == ranking(first)[::-1] and len(keys()) == 2
    SR.cached_rank(spark, path, scores, "ascending", "color-variance", "d")
    assert len(keys()) == 3


def test_half_written_ranking(spark, scores):
    """A ranking without its record is computed again; stored scores are known by their version."""
    path, store = staging_path(spark, "cache"), staging_path(spark, "scores")
    (commits.write_new(rank(scores, "ascending", "edge-density").limit(3), path, "ranking"))
    spark.createDataFrame([], SR.ENTRY).write.parquet(f"{path}/log")  # the log's folder, no record
    want = ranking(rank(scores, "ascending", "edge-density"))
    assert ranking(SR.cached_rank(spark, path, scores, "ascending", "edge-density", "d")) == want
    SC.save_scores(scores, store, "d", 1)
    version = SC.scores_version(spark, store, "d", 1)
    stored = SC.load_scores(spark, store, "d", 1)
    assert ranking(SR.cached_rank(spark, path, stored, "ascending", "edge-density", "d", version=version)) == want
    unread = stored.where(F.raise_error(F.lit("read")).isNull())  # a hit reads no scores
    assert ranking(SR.cached_rank(spark, path, unread, "ascending", "edge-density", "d", version=version)) == want
    SC.save_changes(scores.withColumn("edge-density", -F.col("`edge-density`")), store, "d", 1)
    assert SC.scores_version(spark, store, "d", 1) != version


def test_runs_appended_by_two_writers(spark):
    path = staging_path(spark, "runs")
    rows = spark.createDataFrame([("h1", 0.5), ("h2", 0.7)], "hash string, best double")
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)  # the other writer saw the table before
    assert reports.load_runs(spark, path).count() == 2


def test_sample_report(scores):
    row = reports.sample_report(scores, ["edge-density"]).where("index = 2").first()
    assert list(json.loads(row["report"])) == ["edge-density"]
