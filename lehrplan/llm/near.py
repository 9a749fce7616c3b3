"""Near-duplicate classes by ProbMinHash.

A text is a weighted set of shingles of five words. The shingles of a text send points of
Poisson processes with their weights as rates to the registers of a signature; a register keeps
the shingle whose point comes first, so two texts agree in a register with their probability
Jaccard similarity. A shingle stops as soon as its next point comes after the latest register
of its text. Signatures are cut into bands; texts that share a band are candidates, and a link
needs an exact Jaccard similarity of the distinct shingles of at least the threshold.

Weights rise with the count of a shingle but stay in [1, HEAVIEST), so what is hashed follows
what is verified: probability Jaccard is at least sum(min) / sum(max) of the weights, the sum of
the least is at least the number of shared shingles, and the sum of the greatest less than
HEAVIEST times the number of all. A pair at the threshold has a probability Jaccard of more than
THRESHOLD / HEAVIEST = 0.727, however often its shingles repeat, and bands are sized for that.

Equal texts are one class before anything else and only their first document goes on. Inside a
band every text is compared with the band's first; only where that leaves members of a band in
different components are those compared across components, so a group of copies never makes
all its pairs and no link between components is missed. Texts that cannot link across are left
out by an exact bound: two texts share at most the shingles of either that another of the
compared texts has too, so a text whose own edits weigh too much needs no partner at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm import arrays as A
from lehrplan.llm.components import components
from lehrplan.sources.staging import stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
HEAVIEST = 1.1  # bound of the weights
REGISTERS = 104
BANDS = 26  # of four registers: a pair at 0.8 / 1.1 shares no band once in 5,000
PRUNINGS = 2  # rounds of the exact bound; each sees only what the one before has left

_ROW = np.uint64(52)  # a shingle key: row of the block above, 52 bits of the hash below


def shingles(block: A.Block, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of all rows, sorted, and their counts.

    A text of one to ``size - 1`` words is one shingle; one without words has none.
    """
    _, _, row, word = block.words()
    n = np.bincount(row, minlength=block.rows)
    first = np.cumsum(n) - n
    index = np.arange(len(row)) - first[row]
    short = n[row] < size
    starts = np.flatnonzero((index + size <= n[row]) | (short & (index == 0)))
    total = np.zeros(len(starts), np.uint64)
    limit = first[row[starts]] + n[row[starts]]
    for j in range(size):
        at = starts + j
        inside = at < limit
        value = word[np.where(inside, at, 0)] * np.uint64(pow(int(A.BASE), j + 1, 1 << 64))
        total += np.where(inside, value, np.uint64(0))
    keys = np.sort((row[starts].astype(np.uint64) << _ROW) | (A.mix(total) >> np.uint64(12)))
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(head)
    return keys[at], np.diff(np.append(at, len(keys)))


def bounded(counts: np.ndarray) -> np.ndarray:
    """Weights of shingles that occur ``counts`` times: 1 for one, below HEAVIEST for many."""
    return HEAVIEST - (HEAVIEST - 1) / counts


def signatures(keys: np.ndarray, weights: np.ndarray, rows: int,
               registers: int = REGISTERS) -> np.ndarray:
    """Registers of all rows, shape (rows, registers); rows without shingles hold zeros."""
    row = (keys >> _ROW).astype(np.int64)
    element = A.mix(keys & np.uint64((1 << 52) - 1))
    times = np.full(rows * registers, np.inf)
    kept = np.zeros(rows * registers, np.uint64)
    time = np.zeros(len(keys))
    rate = weights.astype(float)
    step = 0
    while len(row):
        step += 1
        draw = A.mix(element + np.uint64(step * int(A.BASE) % (1 << 64)))
        time = time - np.log1p((draw >> np.uint64(11)).astype(float) * -2.0 ** -53) / rate
        at = row * registers + (A.mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, at, time)
        won = times[at] == time
        kept[at[won]] = element[won]
        alive = time < times.reshape(rows, registers).max(axis=1)[row]
        row, element, time, rate = row[alive], element[alive], time[alive], rate[alive]
    return kept.reshape(rows, registers)


def _sign(batches: Iterator[pa.RecordBatch], registers: int, bands: int,
          ) -> Iterator[pa.RecordBatch]:
    per = registers // bands
    factor = np.array([pow(int(A.BASE), j + 1, 1 << 64) for j in range(per)], np.uint64)
    for batch in batches:
        ids, names = A.column(batch, "doc_id"), A.column(batch, "_key")
        for block in A.blocks(A.column(batch, "text"), 2 * A.BLOCK_BYTES):
            keys, counts = shingles(block)
            full = signatures(keys, bounded(counts), block.rows, registers)
            n = np.bincount((keys >> _ROW).astype(np.int64), minlength=block.rows)
            there = n > 0
            grouped = (full.reshape(block.rows, bands, per) * factor).sum(axis=2, dtype=np.uint64)
            band = A.signed(A.mix(grouped + np.arange(bands, dtype=np.uint64) * A.BASE))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(there * bands)]), pa.int32()),
                pa.array(band[there].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), names.slice(block.first, block.rows),
                 lists, pa.array(n, pa.int64())],
                ["doc_id", "_key", "bands", "n"])


def sign(docs: DataFrame, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """``doc_id``, key of the whole text, band keys and number of distinct shingles of all texts
    but null ones."""
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("_key"))
    return texts.mapInArrow(partial(_sign, registers=registers, bands=bands),
                            "doc_id long, _key binary, bands array<long>, n long")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = A.column(batch, "a_text"), A.column(batch, "b_text")
        value = np.zeros(batch.num_rows)
        for cut in A.blocks(left, 2 * A.BLOCK_BYTES):
            for part in A.blocks(right.slice(cut.first, cut.rows), 2 * A.BLOCK_BYTES):
                first = cut.first + part.first
                a, b = (np.concatenate([shingles(x)[0] + (np.uint64(x.first) << _ROW)
                                        for x in A.blocks(side.slice(first, part.rows))])
                        for side in (left, right))
                same = np.intersect1d(a, b, assume_unique=True)
                n = [np.bincount((k >> _ROW).astype(np.int64), minlength=part.rows)
                     for k in (a, b, same)]
                value[first:first + part.rows] = n[2] / np.maximum(n[0] + n[1] - n[2], 1)
        yield pa.RecordBatch.from_arrays(
            [A.column(batch, "a"), A.column(batch, "b"), pa.array(value)],
            ["a", "b", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose texts reach the threshold, with their exact similarity."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b"))
    return (both.select("a", "b", "a_text", "b_text")
            .mapInArrow(_measure, "a long, b long, similarity double")
            .where(F.col("similarity") >= threshold))


def _list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = A.column(batch, "doc_id")
        for block in A.blocks(A.column(batch, "text"), 2 * A.BLOCK_BYTES):
            keys, _ = shingles(block)
            n = np.bincount((keys >> _ROW).astype(np.int64), minlength=block.rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                pa.array((keys & np.uint64((1 << 52) - 1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.rows), lists],
                                             ["doc_id", "shingles"])


def reach(signed: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, n, top``: distinct shingles, and the most a partner of the threshold may have.

    Only shingles that another text of ``ids`` (repeats allowed) has too can be shared: with r of them, the overlap
    needed, threshold / (1 + threshold) of both sizes, is out of reach for a partner of more than
    r (1 + threshold) / threshold - n shingles. Ids with several texts have no bound.
    """
    each = texts.join(ids, "doc_id", "left_semi").mapInArrow(_list_shingles, "doc_id long, shingles array<long>").select(
        "doc_id", F.explode("shingles").alias("shingle"))
    own = (each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("doc_id"))
           .where("texts = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own")))
    sizes = signed.join(ids, "doc_id", "left_semi").groupBy(
        "doc_id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    return sizes.join(own, "doc_id", "left").select("doc_id", "n", F.when(
        F.col("texts") > 1, F.lit(float("inf"))).otherwise(
        shared * (1 + threshold) / threshold - F.col("n") + 1e-6).alias("top"))


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """Rows of bands that hold several components."""
    bands = stage(rows.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
                  .where("c0 < c1").select("band"), name)
    return rows.join(bands, "band")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, registers: int = REGISTERS,
                      bands: int = BANDS) -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs`` (doc_id, text; others are ignored).

    ``class_id`` is the least doc_id among the documents that equal texts and links of at least
    ``threshold`` connect. A null text is a class of its own, as is a text without words unless
    another equals it; a null doc_id gives a null class. A doc_id that occurs twice is one
    document with the links of all its texts. An empty table gives an empty result.
    """
    signed = stage(sign(docs, registers, bands), "signatures")
    copies = stage(signed.groupBy("_key").agg(F.min("doc_id").alias("first"),
                                              F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("_key", "first"), "copies")
    member = stage(signed.select("doc_id", "_key").join(copies, "_key", "left")
                   .select("doc_id", F.coalesce("first", "doc_id").alias("first")), "members")
    distinct = signed.join(member.where("doc_id = first").select("doc_id").distinct(),
                           "doc_id", "left_semi")
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")

    banded = stage(distinct.select("doc_id", F.explode("bands").alias("band")), "bands")
    hubs = stage(banded.groupBy("band").agg(F.min("doc_id").alias("hub"),
                                            F.max("doc_id").alias("last"))
                 .where("hub < last").select("band", "hub"), "hubs")
    shared = stage(banded.join(hubs, "band"), "shared")
    star = stage(shared.where("doc_id > hub").select(F.col("hub").alias("a"),
                                                     F.col("doc_id").alias("b")).distinct(), "pairs")
    links = stage(verify(star, texts, threshold), "links")
    part = stage(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    placed = stage(shared.join(part, F.col("doc_id") == F.col("node"), "left")
                   .select("band", "doc_id", "hub", F.coalesce("component", "doc_id").alias("c")),
                   "placed")
    # a pair with the hub has been compared already
    rest = stage(_mixed(placed.where("doc_id <> hub"), "mixed"), "rest")
    for _ in range(PRUNINGS):
        bound = stage(reach(signed, texts, rest.select("doc_id"), threshold), "reach")
        sized = stage(rest.select("band", "doc_id", "c").join(
            bound.where(F.col("top") >= F.col("n") * threshold), "doc_id"), "sized")
        least = stage(sized.groupBy("band").agg(F.min("n").alias("least")), "least")
        able = stage(sized.join(least, "band").where("top >= least").drop("least"), "able")
        rest = stage(_mixed(able, "mixed"), "rest")
    # a pair meets in the least of its bands only
    lists = rest.groupBy("doc_id", "c", "n", "top").agg(F.sort_array(F.collect_set("band")).alias("all"))
    spread = stage(lists.select("*", F.posexplode("all").alias("at", "band")).select(
        "band", "doc_id", "c", "n", "top", F.slice("all", F.lit(1), F.col("at")).alias("before")),
        "spread")
    left, right = (spread.select("band", *[F.col(x).alias(f"{x}_{s}") for x in
                                           ("doc_id", "c", "n", "top", "before")]) for s in "ab")
    across = stage(left.join(right, "band").where(
        "doc_id_a < doc_id_b and c_a <> c_b and n_a <= top_b and n_b <= top_a "
        "and not arrays_overlap(before_a, before_b)").select(
        F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct(), "across")
    more = stage(verify(across, texts, threshold), "more")
    # the components found before are stars already
    linked = part.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(
        more.select("a", "b"))
    # a document with several texts joins their classes
    same = member.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    several = member.groupBy("doc_id").agg(F.min("first").alias("f0"), F.max("first").alias("f1"))
    same = several.where("f0 < f1").select(F.col("f0").alias("a"), F.col("f1").alias("b"))
    found = stage(components(linked.unionByName(same).select(F.col("a").alias("u"),
                                                             F.col("b").alias("v"))), "classes")
    class_of = stage(several.join(found, F.col("f0") == F.col("node"), "left")
                     .select(F.col("doc_id").alias("_id"),
                             F.coalesce("component", "f0").alias("_class")), "class-of")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"))
            .join(class_of, F.col("doc_id") == F.col("_id"), "left")
            .select("doc_id", F.coalesce("_class", "doc_id").alias("class_id")))
