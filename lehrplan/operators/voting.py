"""The sequential vote over a whole table, in parallel and with the same result.

The pair (i, j) reads the weights left by (i, j - 1) and (i - 1, j) alone. Cut into blocks of rows,
the pair of blocks (I, J) waits for (I, J - 1) and (I - 1, J), so all pairs with the same I + J vote
at once: in step t block K meets block t - K and no other. A step is one grouped pass over two
blocks a group; inside, the pairs of rows with the same i + j vote together. The work stays
quadratic, as the vote is defined by all pairs, but no task holds more than two blocks. Blocks grow
with the table, so that the number of steps does not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lehrplan.functions.columns import named
from lehrplan.operators.ordering import positions
from lehrplan.sources.staging import stage

BLOCK = 2048         # rows of a block at least
BLOCKS = 24          # blocks of a table; two steps each, so more of them cost more than they spread
LARGEST = 1 << 13    # rows of a block at most: what a task holds stays bounded


def pair_votes(one: np.ndarray, other: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of rows after each pair of them voted with its correlation."""
    up = one >= 0
    apart = (up != (other >= 0)) | (p < 0)  # opposite signs lie on either side of 0: `one < other`
    step = np.where((apart & (one < other)) | (~apart & up), p, -p)
    return one + step, other + np.where(apart, -step, step)


def products(a: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """Correlations of unit rows of ``a`` with those of ``b`` counted from its end, added metric by
    metric, so that no block size changes a bit of them. Rows with gaps correlate with nothing."""
    whole = lambda x: np.where(np.isnan(x).any(axis=1, keepdims=True), 0.0, x)
    x, y = np.ascontiguousarray(whole(a).T), np.ascontiguousarray(whole(b)[::-1].T)

    def along(here: slice, there: slice) -> np.ndarray:
        out = x[0, here] * y[0, there]
        for k in range(1, len(x)):
            out += x[k, here] * y[k, there]
        return out

    return along


def entries(p: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """The same for a matrix of correlations."""
    back = p[:, ::-1]
    return lambda here, there: back[np.arange(here.start, here.stop), np.arange(there.start, there.stop)]


def vote_along(a: np.ndarray, back: np.ndarray, similar: Callable[[slice, slice], np.ndarray],
               within: bool = False) -> None:
    """Pairs along anti-diagonals, in place; ``back`` is the later block (or the same) from its end."""
    rows, cols = len(a), len(back)
    for d in range(int(within), rows + cols - 1 - int(within)):
        low, high = max(0, d - cols + 1), (d - 1) // 2 if within else min(rows - 1, d)
        here, there = slice(low, high + 1), slice(cols - 1 - d + low, cols - d + high)
        a[here], back[there] = pair_votes(a[here], back[there], similar(here, there))


def vote_between(a: np.ndarray, b: np.ndarray, p: np.ndarray | Callable) -> None:
    """All pairs of a row of one block and a row of a later one, in place."""
    back = b[::-1].copy()
    vote_along(a, back, p if callable(p) else entries(p))
    b[:] = back[::-1]


def vote_within(w: np.ndarray, p: np.ndarray | Callable) -> None:
    """All pairs of two rows of a block, in place."""
    vote_along(w, w[::-1], p if callable(p) else entries(p), within=True)


def vote_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """One block by itself, or two with each other."""
    blocks = blocks.sort_values("block")
    w = [np.array(v, float) for v in blocks["w"]]
    x = [np.array(v, float).reshape(len(own), -1) for v, own in zip(blocks["x"], w)]
    if len(w) == 1:
        vote_within(w[0], products(x[0], x[0]))
    else:
        vote_between(w[0], w[1], products(x[0], x[1]))
    return pd.DataFrame({"block": blocks["block"].to_numpy(), "w": w})


def block_rows(rows: int, least: int) -> int:
    """Rows of a block: as many blocks for any table, within bounds."""
    return max(least, min(-(-rows // BLOCKS), LARGEST))


def sequential_weights(rows: DataFrame, vectors: Sequence[str], index: str, row_order: str,
                       block: int = BLOCK) -> DataFrame:
    """``index, weight`` after all pairs of rows have voted in the order of ``row_order``.

    ``vectors`` are the columns of the unit rows; a row with missing ones correlates with nothing.
    ``block`` is the least number of rows of a block; larger tables have larger ones.
    """
    placed = positions(rows, [named(row_order).asc(), named(index).asc()],
                       keep=[index, *vectors], label="vote-rows")
    block = block_rows(placed.count(), block)
    row = F.struct("position", named(index).alias("index"),
                   F.array(*[named(v).cast("double") for v in vectors]).alias("x"))
    blocks = stage(placed.groupBy(F.floor(F.col("position") / block).alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")).select(
        "block", F.col("rows.index").alias("ids"), F.flatten("rows.x").alias("x"),
        F.transform("rows", lambda r: F.lit(0.0)).alias("w")), "vote-blocks")
    count = blocks.count()
    weights = blocks.select("block", "w")
    for step in range(2 * count - 1):
        partner = F.lit(step) - F.col("block")
        meets = (partner >= 0) & (partner < count)
        # a number of partitions of its own, as small shuffles would be merged into few tasks
        voted = blocks.select("block", "x").join(weights.where(meets), "block").withColumn(
            "_pair", F.least("block", partner)).repartition(2 * count, "_pair").groupBy(
            "_pair").applyInPandas(vote_blocks, "block long, w array<double>")
        weights = stage(voted.unionByName(weights.where(~meets)), "vote-weights")
    return blocks.select("block", "ids").join(weights, "block").select(
        F.explode(F.arrays_zip("ids", "w")).alias("_r")).select(
        F.col("_r.ids").alias(index), F.col("_r.w").alias("weight"))
