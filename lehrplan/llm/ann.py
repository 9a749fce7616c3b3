"""Nearest neighbours by adaptive scan of dimensions inside probed lists.

Vectors are scaled to length 1 and rotated at random, which spreads their differences evenly
over all dimensions. Centroids from a bounded sample cut them into lists; a list is stored in
blocks of bounded size, column block by column block. A query visits its nearest lists. After
each column block the partial distance of a candidate, scaled up to all dimensions, is tested
against the distance of the fifth neighbour found so far; if it is too large beyond chance the
candidate is abandoned. What remains is measured exactly on the original vectors.

A list that holds a third of all vectors is many blocks, and the queries of a list come in
groups, so a task holds one block and one group of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lehrplan.llm import arrays as A
from lehrplan.sources.staging import stage

SAMPLE = 16_384       # vectors that centroids are fitted on, by hash of vec_id
MOST_LISTS = 4096
GOAL = 0.97           # share of the sample's true neighbours that the visited lists must hold
ASKED = 256           # vectors of the sample that ask for this
BLOCK = 2048          # vectors of a block
GROUP = 512           # queries of a group
COLUMNS = 16          # dimensions of a column block
EPSILON = 2.1         # width of the test, in standard errors of a partial distance


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows ``vec_id, vector`` that take part: no null, non-finite or zero vectors, and only
    the most frequent number of dimensions (the larger on a tie). A vec_id counts once."""
    v = F.col(column).cast("array<double>")
    sound = vectors.where("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(
        (F.size("vector") > 0) &
        ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) &
        F.exists("vector", lambda x: x != 0.0))
    sizes = sound.groupBy(F.size("vector").alias("d")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return sound.where(F.size("vector") == (best["d"] if best else 0)).dropDuplicates(["vec_id"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # neither tiny nor huge components under- or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Lists:
    """Rotation and centroids; bounded by `MOST_LISTS`, so they travel with the task."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, turns: int = 10):
        draw = np.random.default_rng(seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(draw.standard_normal((d, d)))[0]
        x = _unit(sample) @ self.rotation
        centers = x[draw.permutation(len(x))[:lists]]
        for _ in range(turns):
            own = self._near(x, centers)
            total = np.zeros_like(centers)
            np.add.at(total, own, x)
            size = np.bincount(own, minlength=len(centers))
            centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
        self.centers = centers

    @staticmethod
    def _near(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers * centers).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return _unit(vectors) @ self.rotation

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return self._near(self.rotate(vectors), self.centers)

    def share(self, sample: np.ndarray, k: int, goal: float = GOAL) -> float:
        """Least share of lists, nearest first, that holds ``goal`` of the true neighbours.

        Neighbours inside the sample are farther than those in all vectors, so the share is
        rather too large than too small.
        """
        x = self.rotate(sample)
        own = self._near(x, self.centers)
        asked = x[:ASKED]
        close = asked @ x.T
        close[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1.0
        true = np.argpartition(-close, k - 1, axis=1)[:, :k]
        away = (self.centers ** 2).sum(axis=1) - 2 * asked @ self.centers.T
        rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[true], axis=1).ravel()) + 1
        return needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))))] / len(self.centers)

    def visits(self, vectors: np.ndarray, sizes: np.ndarray, share: float, least: int) -> list[np.ndarray]:
        """Nearest non-empty lists: a share of them, and more until they hold ``least`` vectors."""
        there = np.flatnonzero(sizes)
        away = (self.centers[there] ** 2).sum(axis=1) - 2 * self.rotate(vectors) @ self.centers[there].T
        order = there[np.argsort(away, axis=1, kind="stable")]
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        number = np.maximum(enough, int(np.ceil(share * len(there))))
        return [row[:n].astype(np.int32) for row, n in zip(order, number)]


def _assign(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own = lists.assign(_matrix(A.column(batch, "vector")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list"])


def _visit(batches: Iterator[pa.RecordBatch], lists: Lists, sizes: np.ndarray, share: float,
           least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            visits = lists.visits(_matrix(A.column(batch, "vector")), sizes, share, least)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(visits, pa.list_(pa.int32()))],
                [*batch.schema.names, "lists"])


def survivors(queries: np.ndarray, block: np.ndarray, k: int, columns: int = COLUMNS,
              epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons; rows are rotated unit vectors."""
    d = block.shape[1]
    stored = [np.ascontiguousarray(block[:, c:c + columns].T) for c in range(0, d, columns)]
    head = stored[0]
    part = ((queries[:, :columns] ** 2).sum(axis=1)[:, None] + (head ** 2).sum(axis=0)
            - 2 * queries[:, :columns] @ head)
    # the first bound: the k-th of some candidates whose whole distance is known
    if len(block) > k:
        few = np.argpartition(part, min(4 * k, len(block) - 1), axis=1)[:, :4 * k + 1]
        known = ((queries[:, None, :] - block[few]) ** 2).sum(axis=2)
        bound = np.partition(known, k - 1, axis=1)[:, k - 1] if known.shape[1] >= k else \
            np.full(len(queries), np.inf)
    else:
        bound = np.full(len(queries), np.inf)
    q, x = np.nonzero(part * (d / min(columns, d)) <=
                      (bound * (1 + epsilon / np.sqrt(min(columns, d))) ** 2)[:, None] + 1e-12)
    away = part[q, x]
    for c, store in enumerate(stored[1:], 1):
        low, seen = c * columns, min((c + 1) * columns, d)
        away = away + ((queries[q, low:seen] - store[:, x].T) ** 2).sum(axis=1)
        wide = 1.0 if seen == d else (1 + epsilon / np.sqrt(seen)) ** 2
        near = away * (d / seen) <= bound[q] * wide + 1e-9
        q, x, away = q[near], x[near], away[near]
    return q, x


def _search(left: pa.Table, right: pa.Table, lists: Lists, k: int) -> pa.Table:
    """The k nearest of one block for each query of one group."""
    names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], t) for n, t in names.items()})
    qid, xid = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "vec_id")))
    vectors, block = _matrix(left.column("vector")), _matrix(right.column("vector"))
    # one more than k: a query may meet itself
    q, x = survivors(lists.rotate(vectors), lists.rotate(block), k + 1)
    other = qid[q] != xid[x]
    q, x = q[other], x[other]
    unit_q, unit_x = _unit(vectors), _unit(block)
    score = np.clip((unit_q[q] * unit_x[x]).sum(axis=1), -1.0, 1.0)
    order = np.lexsort((xid[x], -score, q))
    q, x, score = q[order], x[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    best = rank < k
    return pa.table({"query_id": qid[q[best]], "vec_id": xid[x[best]], "score": score[best]})


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, goal: float = GOAL,
            sample: int = SAMPLE, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by cosine for each row whose
    vec_id is divisible by ``every``, among all other rows of ``vectors`` (vec_id, ``column``).

    Ties go to the smaller vec_id. Fewer candidates than ``k`` are all returned; rows that take
    no part (see `usable`) neither ask nor answer. A vec_id that occurs twice counts once. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    sound = stage(usable(vectors, column), "vectors")
    total = sound.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    draw = F.xxhash64("vec_id").cast("double") / F.lit(2.0 ** 64) + 0.5
    taken = (sound.where(draw <= min(1.0, sample / total)).limit(2 * sample)
             if total > sample else sound).select("vec_id", "vector").toArrow()
    taken = taken.sort_by("vec_id")
    learned = _matrix(taken.column("vector"))
    lists = Lists(learned, min(MOST_LISTS, max(1, round(total ** 0.5))))
    share = lists.share(learned, k, goal)
    kind = "vec_id long, vector array<double>"
    stored = stage(sound.mapInArrow(partial(_assign, lists=lists), f"{kind}, list int"), "lists")
    sizes = np.zeros(len(lists.centers), np.int64)
    for r in stored.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    asked = stage(sound.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(
        partial(_visit, lists=lists, sizes=sizes, share=share, least=8 * (k + 1)),
        f"{kind}, lists array<int>")
        .select(F.col("vec_id").alias("query_id"), "vector", F.explode("lists").alias("list")), "asked")
    visits = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    shape = spark.createDataFrame(
        [(i, int(-(-n // BLOCK)), -(-visits.get(i, 0) // GROUP)) for i, n in enumerate(sizes) if n],
        "list int, blocks long, groups long")  # at most MOST_LISTS rows
    blocks = stored.join(F.broadcast(shape), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"),
        F.explode(F.expr("if(groups > 0, sequence(0L, groups - 1), array())")).alias("grp"),
        "vec_id", "vector")
    groups = asked.join(F.broadcast(shape), "list").select(
        "list", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("groups")).alias("grp"), "query_id", "vector")
    key = ["list", "block", "grp"]
    search = partial(_search, lists=lists, k=k)
    found = groups.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(
        lambda left, right: search(left, right), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
