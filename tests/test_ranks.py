import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lehrplan.operators import curriculum as C
from lehrplan.operators.normalize import standardize
from lehrplan.operators.ranks import rank, rank_key, sequential_votes, unit_rows, unit_rows_of
from lehrplan.operators.voting import (LARGEST, block_rows, pair_votes, products,
                                       sequential_weights, vote_between, vote_within)
from lehrplan.registry import METRICS, RANKS
import lehrplan.operators.image_kernels  # noqa: F401  registers the image metrics
from tests.conftest import ranking, table

FOUR = ["edge-density", "color-variance", "object-count", "wavelet-energy"]


@pytest.mark.parametrize("scheme", ["ascending", "descending", "distance-from-mean",
                                    "lexicographic", "normalized-mean", "weighted",
                                    "correlation-sum"])
def test_permutation(scores, scheme):
    metrics = FOUR if scheme == "correlation-sum" else "object-count"
    assert sorted(ranking(rank(scores, scheme, metrics))) == list(range(24))


def test_monotonic(scores):
    value = {r["index"]: r["object-count"] for r in scores.collect()}
    up = ranking(rank(scores, "ascending", "object-count"))
    assert [value[i] for i in up] == sorted(value.values())
    assert ranking(rank(scores, "descending", "object-count")) == up[::-1]


def test_missing_values_come_last_both_ways(spark):
    nan = float("nan")
    df = table(spark, [(0, "a", nan), (1, "a", 2.0), (2, "a", None), (3, "a", 1.0)],
               ["index", "class", "m"])
    assert ranking(rank(df, "ascending", "m")) == [3, 1, 0, 2]
    assert ranking(rank(df, "descending", "m")) == [1, 3, 0, 2]


def test_distance_from_mean(spark):
    values = np.array([40.0, 7.5, 12.0, 90.0, 33.0, 28.5, 11.0])
    df = table(spark, [(i, "a", float(v)) for i, v in enumerate(values)], ["index", "class", "m"])
    away = np.abs(values - values.mean())
    assert ranking(rank(df, "distance-from-mean", "m")) == np.argsort(away, kind="stable").tolist()


def test_lexicographic(spark):
    draw = np.random.default_rng(8)
    pairs = np.column_stack([draw.integers(0, 4, 15), draw.integers(-3, 3, 15)]).astype(float)
    df = table(spark, [(i, "a", *map(float, p)) for i, p in enumerate(pairs)],
               ["index", "class", "x", "y"])
    assert ranking(rank(df, "lexicographic", ["x", "y"])) == np.lexsort(pairs.T[::-1]).tolist()
    assert ranking(rank(df, "lexicographic", ["y", "x"])) == np.lexsort(pairs.T).tolist()
    assert ranking(rank(df, "lexicographic", "x")) == ranking(rank(df, "ascending", "x"))


def test_normalized_mean(spark, scores):
    draw = np.random.default_rng(77)
    frame = np.column_stack([draw.normal(3, 2, 17), draw.uniform(-500, 900, 17), np.full(17, -2.5)])
    df = table(spark, [(i, "a", *map(float, r)) for i, r in enumerate(frame)],
               ["index", "class", "p", "q", "still"])
    width = np.ptp(frame, axis=0)
    unit = (frame - frame.min(axis=0)) / np.where(width > 0, width, 1.0)
    for turned in ([], ["q"], ["p", "still"]):
        sides = np.where([c in turned for c in ("p", "q", "still")], 1 - unit, unit)
        keys = rank_key(df, "normalized-mean", ["p", "q", "still"], inverted=turned)
        got = [r["key"] for r in sorted(keys.collect(), key=lambda r: r["index"])]
        np.testing.assert_allclose(got, sides.mean(axis=1), atol=1e-12)
    one = ranking(rank(scores, "normalized-mean", ["color-variance"]))
    assert one == ranking(rank(scores, "ascending", "color-variance"))


def test_compression_ratio_is_inverted_by_tag(spark):
    df = table(spark, [(i, "a", float(i)) for i in range(5)],
               ["index", "class", "compression-ratio"])
    assert METRICS.ids(["inverted"]) == ["compression-ratio"]
    assert ranking(rank(df, "normalized-mean", ["compression-ratio"])) == [4, 3, 2, 1, 0]


def numpy_weighted(frame, anchor):
    """The anchor's standard scores plus those of the others, by share of absolute correlation."""
    data = np.ma.masked_invalid(frame.to_numpy(dtype=float))
    spread = np.ma.std(data, axis=0, ddof=1)
    scores = (data - data.mean(axis=0)) / np.ma.masked_equal(spread, 0)
    k = list(frame.columns).index(anchor)
    share = np.zeros(data.shape[1])
    for j in set(range(data.shape[1])) - {k}:
        both = ~(np.ma.getmaskarray(data)[:, j] | np.ma.getmaskarray(data)[:, k])
        if spread[j] and both.sum() > 1:
            share[j] = abs(np.corrcoef(np.asarray(data[both][:, [k, j]]).T)[0, 1])
    share /= share.sum()
    return pd.Series(np.ma.filled(scores[:, k], np.nan) + np.ma.filled(scores, 0.0) @ share,
                     index=frame.index)


@pytest.mark.parametrize("anchor", FOUR)
def test_weighted_against_numpy(scores, anchor):
    frame = scores.toPandas().set_index("index")[FOUR].sort_index()
    want = list(numpy_weighted(frame, anchor).sort_values(kind="stable").index)
    assert ranking(rank(scores, "weighted", anchor)) == want


def test_weighted_with_constant_and_missing(spark):
    frame = pd.DataFrame({"a": [1.0, 5.0, np.nan, 2.0], "b": [4.0] * 4,
                          "c": [9.0, 1.0, 2.0, np.nan]})
    rows = [(i, "x", *[None if np.isnan(v) else float(v) for v in r])
            for i, r in enumerate(frame.to_numpy())]
    df = table(spark, rows, ["index", "class", "a", "b", "c"])
    order = numpy_weighted(frame, "a").sort_values(kind="stable", na_position="last")
    assert ranking(rank(df, "weighted", "a")) == list(order.index)
    assert all(r["b"] is None for r in standardize(df, ["a", "b"]).collect())


@pytest.mark.parametrize("scheme", ["ascending", "descending", "distance-from-mean", "weighted"])
def test_single_metric_schemes_reject_lists(scores, scheme):
    with pytest.raises(ValueError):
        rank(scores, scheme, FOUR[:2])


def test_errors(scores):
    with pytest.raises(KeyError):
        rank(scores, "ascending", "no-such-metric")
    with pytest.raises(KeyError):
        rank(scores, "no-such-scheme", "edge-density")
    with pytest.raises(ValueError):
        rank(scores, "pairwise-correlation", FOUR, partition_by="class")
    with pytest.raises(ValueError):
        C.curriculum(scores, "ascending", "edge-density", scope="sideways")


# The vote, restated case by case ----------------------------------------------------------

def votes_by_rule(x):
    w = [0.0] * len(x)
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            p = float(np.dot(x[i], x[j]))
            p = 0.0 if np.isnan(p) else p
            a, b = w[i], w[j]
            if a >= 0 > b:
                di, dj = -p, p
            elif a < 0 <= b:
                di, dj = p, -p
            elif p >= 0:
                di = dj = p if a >= 0 else -p
            else:
                di, dj = (p, -p) if a < b else (-p, p)
            w[i], w[j] = a + di, b + dj
    return w


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.one_of(st.floats(-5, 5), st.just(float("nan"))), min_size=3,
                         max_size=3), min_size=1, max_size=20))
def test_votes(rows):
    stack = np.full((2, len(rows) + 2, 3), np.nan)  # padded, next to another batch
    stack[0, :len(rows)], stack[1] = rows, np.arange(3 * (len(rows) + 2)).reshape(-1, 3)
    x = unit_rows_of(stack, [1])
    got = sequential_votes(x)
    np.testing.assert_allclose(got[0, :len(rows)], votes_by_rule(x[0, :len(rows)]), atol=1e-9)
    np.testing.assert_allclose(got[1], votes_by_rule(x[1]), atol=1e-9)


def test_pairwise_batches(spark, scores):
    cut = C.batch_wise(scores, "pairwise-correlation", FOUR, 8, seed=2, inverted=[])
    chunks = C.batch_wise(scores, "ascending", "edge-density", 8, seed=2)
    members = lambda df: {b: set(g["index"]) for b, g in df.toPandas().groupby("batch_idx")}
    assert members(cut) == members(chunks)
    from lehrplan.operators.ordering import shuffled
    drawn = shuffled(scores, 2).toPandas().sort_values("position")["index"].tolist()
    frame = scores.toPandas().set_index("index")
    for b, g in cut.toPandas().groupby("batch_idx"):
        ids = drawn[b * 8:(b + 1) * 8]
        w = votes_by_rule(unit_rows_of(frame.loc[ids, FOUR].to_numpy()[None], [])[0])
        want = [i for _, i in sorted(zip(np.round(w, 9), ids))]
        assert g.sort_values("pos_in_batch")["index"].tolist() == want


def test_votes_across_frames(spark, scores, monkeypatch):
    """Small stacks and small Arrow frames give the same batches."""
    from lehrplan.operators import ranks as R
    whole = C.batch_wise(scores, "pairwise-correlation", FOUR, 7).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(R, "VOTE_ROWS", 5)
    try:
        parts = C.batch_wise(scores, "pairwise-correlation", FOUR, 7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    assert sorted(whole) == sorted(parts)


def test_correlation_sum_equals_all_pairs(scores):
    frame = scores.toPandas().sort_values("index")
    x = unit_rows_of(frame[FOUR].to_numpy()[None], [])[0]
    pairs = x @ x.T
    want = pairs.sum(axis=1) - np.diag(pairs)
    got = rank_key(scores, "correlation-sum", FOUR).toPandas().sort_values("index")["key"]
    np.testing.assert_allclose(got, want, atol=1e-9)


# Batches ----------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [4, 6, 50])
def test_holistic_batches(scores, size):
    order = ranking(rank(scores, "ascending", "edge-density"))
    cut = C.holistic(scores, "ascending", "edge-density", size).toPandas()
    cut = cut.sort_values(["batch_idx", "pos_in_batch"])
    assert cut["index"].tolist() == order
    assert cut["batch_idx"].nunique() == -(-24 // size)
    assert C.coverage(C.holistic(scores, "ascending", "edge-density", size), scores).count() == 0


def test_batch_wise_is_sorted_inside(scores):
    value = {r["index"]: r["edge-density"] for r in scores.collect()}
    cut = C.batch_wise(scores, "ascending", "edge-density", 6).toPandas()
    for _, g in cut.groupby("batch_idx"):
        inside = [value[i] for i in g.sort_values("pos_in_batch")["index"]]
        assert inside == sorted(inside)
    whole = C.holistic(scores, "ascending", "edge-density", 6).toPandas()
    keyed = lambda df: {(r.batch_idx, r.pos_in_batch): r.index for r in df.itertuples(index=False)}
    assert keyed(cut) != keyed(whole)


def test_batch_wise_weighted_uses_chunk_statistics(scores):
    cut = C.batch_wise(scores, "weighted", "edge-density", 10, seed=3).toPandas()
    frame = scores.toPandas().set_index("index")[FOUR]
    for _, g in cut.groupby("batch_idx"):
        ids = sorted(g["index"])
        want = numpy_weighted(frame.loc[ids], "edge-density").sort_values(kind="stable").index
        assert g.sort_values("pos_in_batch")["index"].tolist() == list(want)


@pytest.mark.parametrize("scheme", ["distance-from-mean", "weighted", "descending"])
def test_groups_of_any_size(scores, scheme):
    """The way for unbounded groups gives the same as the one for batches."""
    ways = [sorted(rank(scores, scheme, "edge-density", partition_by="class", bounded=b)
                   .select("class", "index", "position").collect()) for b in (True, False)]
    assert ways[0] == ways[1]


def test_class_balanced_keeps_shares(spark):
    rows = [(i, "big" if i % 4 else "small", i * 10) for i in range(40)]
    ranked = spark.createDataFrame(rows, "index long, class string, position long")
    cut = C.class_balanced(ranked, 8).toPandas()
    names = {i: c for i, c, _ in rows}
    for _, g in cut.groupby("batch_idx"):
        assert sum(names[i] == "small" for i in g["index"]) == 2


def test_coverage_reports_each_problem(spark, scores):
    batches = spark.createDataFrame([(0, 0, i) for i in [*range(1, 24), 5, 99]],
                                    "batch_idx int, pos_in_batch int, index long")
    found = {r["index"]: r["problem"] for r in C.coverage(batches, scores).collect()}
    assert found == {0: "missing", 5: "repeated", 99: "unknown"}


def test_registered_tags():
    assert set(RANKS.ids(["composite"])) == {"lexicographic", "normalized-mean", "weighted",
                                             "correlation-sum", "pairwise-correlation"}
    assert RANKS.ids(["monotonic"]) == ["ascending", "descending"]


@pytest.mark.parametrize("block", [1, 7, 40, 500])
def test_vote_in_blocks(spark, block):
    """Blocks in step give the vote of one task, over one row a block and over blocks larger than
    the table; rows that miss a metric correlate with nothing."""
    draw = np.random.default_rng(block)
    n = 60 if block == 1 else 130
    values = np.column_stack([draw.normal(0, 1, n), draw.gamma(2, 3, n), draw.random(n), draw.beta(1, 3, n)])
    values[draw.integers(0, n, 5), 1] = np.nan
    order = draw.permutation(n)
    names = ["a", "b", "c", "d"]
    rows = [(int(i), None, *[None if np.isnan(v) else float(v) for v in values[i]], float(order[i]))
            for i in range(n)]
    df = table(spark, rows, ["index", "class", *names, "drawn"])
    want = sequential_votes(unit_rows_of(values[np.argsort(order)][None], [1]))[0]
    weights = sequential_weights(unit_rows(df, names, None, ["b"]), [f"_x{i}" for i in range(4)],
                                 "index", "drawn", block)
    got = {r["index"]: r["weight"] for r in weights.collect()}
    np.testing.assert_allclose([got[i] for i in np.argsort(order)], want, atol=1e-9)
    ranked = rank(df, "pairwise-correlation", names, inverted=["b"], row_order="drawn", digits=9)
    assert sorted(ranking(ranked)) == list(range(n))


def test_vote_between_blocks_is_the_vote_of_pairs():
    """Pairs along anti-diagonals against pairs one after the other."""
    draw = np.random.default_rng(3)
    for rows, cols in ((1, 1), (1, 5), (4, 1), (5, 8), (9, 6)):
        p = draw.normal(0, 1, (rows, cols))
        a, b = draw.normal(0, 1, rows), draw.normal(0, 1, cols)
        own, other = a.copy(), b.copy()
        for i in range(rows):
            for j in range(cols):
                own[i:i + 1], other[j:j + 1] = pair_votes(own[i:i + 1], other[j:j + 1], p[i:i + 1, j])
        vote_between(a, b, p)
        np.testing.assert_array_equal(a, own)
        np.testing.assert_array_equal(b, other)


def test_batch_size_is_checked(scores):
    with pytest.raises(ValueError, match="batch_size"):
        C.batch_wise(scores, "pairwise-correlation", FOUR, 0)


def test_blocks_grow_with_the_table():
    """Steps do not grow with the table, and a task's rows stay bounded."""
    assert [block_rows(n, 64) for n in (1000, 60_000, 10**7)] == [64, 2500, LARGEST]


def test_products_are_those_of_pairs():
    """Votes along anti-diagonals against pairs one after the other; gaps correlate with nothing."""
    x = np.random.default_rng(8).normal(0, 1, (40, 3))
    x[[4, 30]] = np.nan
    want = np.zeros(40)
    for i in range(40):
        for j in range(i + 1, 40):
            p = np.nan_to_num(np.array([x[i, 0] * x[j, 0] + x[i, 1] * x[j, 1] + x[i, 2] * x[j, 2]]))
            want[i:i + 1], want[j:j + 1] = pair_votes(want[i:i + 1], want[j:j + 1], p)
    for cut in (1, 17, 39):
        a, b = np.zeros(cut), np.zeros(40 - cut)
        vote_within(a, products(x[:cut], x[:cut]))
        vote_between(a, b, products(x[:cut], x[cut:]))
        vote_within(b, products(x[cut:], x[cut:]))
        np.testing.assert_array_equal(np.concatenate([a, b]), want)


def test_sums_of_a_batch_follow_its_row_order(spark):
    """The mean is added in the order rows were drawn, whatever order they arrive in: 0 here, so the
    last two are equally far from it; in the order of arrival it is 0.2."""
    rows = [(0, None, 1e16, 0.0), (1, None, -1e16, 2.0), (2, None, 1.0, 1.0), (4, None, 0.25, 3.0),
            (3, None, -0.25, 4.0)]
    df = table(spark, rows, ["index", "class", "v", "drawn"]).coalesce(1).withColumn("b", F.lit(0))
    ranked = rank(df, "distance-from-mean", "v", partition_by="b", bounded=True, row_order="drawn")
    assert ranking(ranked)[:2] == [3, 4]


def test_votes_of_a_batch_add_metric_by_metric():
    """Scaling and correlations in the order of the metrics, as SQL adds them, to the last bit."""
    values = np.random.default_rng(12).gamma(2, 3, (20, 12, 5))
    got = sequential_votes(unit_rows_of(values, []))
    for batch, weights in zip(values.tolist(), got):
        low, high = [min(c) for c in zip(*batch)], [max(c) for c in zip(*batch)]
        want, unit = [0.0] * len(batch), []
        for row in batch:
            s = [(v - a) / (b - a) for v, a, b in zip(row, low, high)]
            mean = (s[0] + s[1] + s[2] + s[3] + s[4]) / 5
            c = [v - mean for v in s]
            norm = (c[0] * c[0] + c[1] * c[1] + c[2] * c[2] + c[3] * c[3] + c[4] * c[4]) ** 0.5
            unit.append([v / norm for v in c])
        for i, x in enumerate(unit):
            for j, y in enumerate(unit[i + 1:], i + 1):
                p = x[0] * y[0] + x[1] * y[1] + x[2] * y[2] + x[3] * y[3] + x[4] * y[4]
                one, other = pair_votes(np.array([want[i]]), np.array([want[j]]), np.array([p]))
                want[i], want[j] = float(one[0]), float(other[0])
        assert weights.tolist() == want
