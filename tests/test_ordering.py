from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lehrplan.operators.asof import asof_join
from lehrplan.operators.ordering import expand_range, positions, shuffled
from lehrplan.sources import staging


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are missing."""
    rows = [(i, 7.0 if i % 3 == 0 else (None if i % 50 == 1 else float(i * 37 % 101)),
             "hot" if i % 3 else "cold" if i % 2 else None) for i in range(6000)]
    return spark.createDataFrame(rows, "index long, v double, g string").repartition(8)


def expected(rows, by=None):
    groups = defaultdict(list)
    for r in rows:
        groups[r["g"] if by else None].append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r["v"] is None, r["v"] or 0.0, r["index"]))
        out.update({r["index"]: p for p, r in enumerate(members)})
    return out


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_equal_a_full_sort(skewed, by):
    got = positions(skewed, [F.col("v").asc_nulls_last(), F.col("index").asc()], ["index"],
                    by=by, with_size=True)
    rows = got.collect()
    assert {r["index"]: r["position"] for r in rows} == expected(skewed.collect(), by)
    sizes = defaultdict(int)
    for r in skewed.collect():
        sizes[r["g"] if by else 0] += 1
    assert all(r["size"] == sizes[r["g"] if by else 0] for r in rows)


def test_hot_key_is_split(spark, skewed):
    """The hot key's rows do not end up in one partition of the sort."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sort = [F.col("v").asc_nulls_last(), F.col("index").asc()]
        parts = (skewed.repartitionByRange(8, *sort).select(F.spark_partition_id().alias("p"))
                 .groupBy("p").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in parts) < 2000


def test_no_single_partition_over_rows(skewed):
    """Only the per-partition marks (already aggregated) meet in one task."""
    plan = positions(skewed, [F.col("v").asc(), F.col("index").asc()], ["index"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1
    assert "HashAggregate" in plan[plan.index("SinglePartition"):]


def test_empty_table(spark):
    none = spark.createDataFrame([], "index long, v double")
    assert positions(none, [F.col("v").asc(), F.col("index").asc()], ["index"]).count() == 0


def test_shuffle_is_reproducible_and_a_permutation(skewed):
    first = shuffled(skewed, seed=4).collect()
    again = shuffled(skewed.repartition(3), seed=4).collect()
    other = shuffled(skewed, seed=5).collect()
    as_map = lambda rows: {r["index"]: r["position"] for r in rows}
    assert as_map(first) == as_map(again) != as_map(other)
    assert sorted(as_map(first).values()) == list(range(6000))


def test_expand_range_in_blocks(spark):
    runs = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "run string, n int")
    rows = expand_range(runs, F.col("n"), "i", block=4).collect()
    assert sorted((r["run"], r["i"]) for r in rows) == \
        [("a", i) for i in range(10)] + [("b", i) for i in range(3)]


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, *a: None})()

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())
    assert staging.staging_path(spark, "x").startswith(staging.shared_folder(spark))


@pytest.mark.parametrize("rows", [3, 50, 1 << 18])
def test_asof_join(spark, rows):
    """Against pandas, over ranges of a few rows; a hot key, gaps, equal times, clashing names."""
    draw = np.random.default_rng(rows)
    key = lambda n: np.where(draw.random(n) < 0.4, "hot", draw.choice(["a", "b", "c"], n))
    left = pd.DataFrame({"id": range(300), "k": key(300), "at": draw.integers(0, 200, 300), "value": 1.0})
    right = pd.DataFrame({"k": key(120), "at": draw.integers(20, 220, 120), "value": draw.random(120).round(6)})
    right["ends"] = right["at"] + draw.integers(0, 30, 120)
    nulls = spark.createDataFrame([(1000, None, 5, 1.0), (1001, "hot", None, 1.0)],
                                  "id long, k string, at long, value double")
    left_df = spark.createDataFrame(left).unionByName(nulls).withColumnRenamed("value", "_held")
    got = asof_join(left_df, spark.createDataFrame(right), "at", ["k"], ["value", "ends"], rows=rows).toPandas()
    top = right.sort_values(["value", "ends"]).groupby(["k", "at"], as_index=False).last()
    want = pd.merge_asof(left.sort_values("at"), top.sort_values("at"), on="at", by="k", suffixes=("", "_r"))
    want = want.set_index("id")
    assert len(got) == 302 and set(got.columns) == {"id", "k", "at", "_held", "value", "ends"}
    for r in got.itertuples():
        expect = np.nan if r.id >= 1000 else want.loc[r.id, "value_r"]
        assert (np.isnan(expect) and np.isnan(r.value)) or r.value == expect
    held = asof_join(left_df, spark.createDataFrame(right), "at", ["k"], ["value"], "ends", rows=rows).toPandas()
    for r in held.itertuples():
        if r.id < 1000:
            row = want.loc[r.id]
            expect = row["value_r"] if row["at"] < row["ends"] else np.nan
            assert (np.isnan(expect) and np.isnan(r.value)) or r.value == expect
    assert asof_join(left_df, spark.createDataFrame(right).limit(0), "at", ["k"], ["value"]).where(
        "value is null").count() == 302
    assert asof_join(left_df.limit(0), spark.createDataFrame(right), "at", ["k"], ["value"]).count() == 0
