"""How text filters act together, in every order.

One pass over the UTF-8 bytes measures a text: a transducer of two states (between words, inside
one) reads a table of actions by state and byte. Its next state depends on the byte alone, so the
states before all bytes are one table look-up of the bytes before them, and the actions another.
Word spans go into a hash table that compares bytes, which counts distinct words exactly.

What a document fails is a pattern of five bits. All orders of the filters are judged from the
number of documents of each pattern, so the work after the pass is grouped counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lehrplan.llm.arrays import VALUES, BASE, Block, blocks, column, first_equal, mix, powers, utf8
from lehrplan.sources.staging import stage

FILTERS = "ABCDE"
WINDOW = 1 << 20
SCHEMA = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"

# the transducer: states, and actions as bits
GAP, WORD = 0, 1
BEGINS, CAPITAL, POINT, SYMBOL, ENDS = 1, 2, 4, 8, 16


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """State after every byte, and the actions of every byte in every state.

    A byte that goes on a code point (10xxxxxx) is no code point of its own and is never white
    space, so it stays in the word.
    """
    after = np.full(256, WORD, np.uint8)
    after[[32, *range(9, 14)]] = GAP
    actions = np.zeros((2, 256), np.uint8)
    actions[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    actions[:, ord("A"):ord("Z") + 1] |= CAPITAL
    actions[:, [ord(c) for c in "#$%&*|"]] |= SYMBOL
    actions[GAP, after == WORD] |= BEGINS
    actions[WORD, after == GAP] |= ENDS
    return after, actions


AFTER, ACTIONS = _transducer()


def transduce(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The actions of all bytes; every row begins between words."""
    state = np.zeros(len(data), np.uint16)
    state[1:] = AFTER[data[:-1]]
    state[offsets[:-1][offsets[:-1] < len(data)]] = GAP
    return ACTIONS.ravel()[state << 8 | data]


def spans(actions: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    starts = np.flatnonzero(actions & BEGINS)
    row = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.flatnonzero(actions & ENDS)
    # a word ends at the next white space or with its row
    stops = np.append(stops, len(actions))[np.searchsorted(stops, starts)]
    return starts, np.minimum(stops, offsets[row + 1]), row


def _windows(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block's bytes and row bounds; one long row in pieces that end behind white space."""
    if block.rows > 1 or len(block.data) <= WINDOW:
        yield block.data, block.offsets
        return
    at, width = 0, WINDOW
    while at < len(block.data):
        data = block.data[at:at + width]
        if at + width < len(block.data):
            gaps = np.flatnonzero(AFTER[data] == GAP)
            if not len(gaps):
                width *= 2
                continue
            data = data[:gaps[-1] + 1]
        yield data, np.array([0, len(data)])
        at, width = at + len(data), WINDOW


def _count(bits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bits) + 1, np.int64)
    np.cumsum(bits != 0, out=total[1:])
    return np.diff(total[offsets])


def measured(block: Block) -> tuple[np.ndarray, ...]:
    """Words, distinct words, capitals, code points and symbols of every row."""
    out, seen = [np.zeros(block.rows, np.int64) for _ in range(5)], set()
    for data, offsets in _windows(block):
        actions = transduce(data, offsets)
        starts, ends, row = spans(actions, offsets)
        sums = Block(0, data, offsets).prefix(VALUES[data])
        hashes = (sums[ends] - sums[starts]) * powers(BASE, len(data) + 1)[starts]
        hashes = mix(mix(hashes ^ (ends - starts).astype(np.uint64)) + row.astype(np.uint64) * BASE)
        own = np.flatnonzero(first_equal(data, starts, ends, hashes, row) == np.arange(len(starts)))
        out[0] += np.bincount(row, minlength=block.rows)
        for total, bit in zip(out[2:], (CAPITAL, POINT, SYMBOL)):
            total += _count(actions & bit, offsets)
        if len(data) < len(block.data):  # a long row: its words are kept between windows
            raw = data.tobytes()
            seen.update(raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist()))
            out[1][0] = len(seen)
        else:
            out[1] += np.bincount(row[own], minlength=block.rows)
    return tuple(out)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        data, offsets = utf8(texts)
        digests = pa.array([hashlib.sha256(data[a:b]).digest()
                            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
        parts = [measured(block) for block in blocks(texts)]
        counts = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64())
                  for i in range(5)]
        kept = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + counts + [digests],
            [batch.schema.names[i] for i in kept]
            + ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols", "digest"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, part`` and the counts of every whole text of ``docs`` (doc_id, text, lang):
    words, distinct words, characters A-Z, code points and signs ``#$%&*|``, and the sha256 of
    its bytes. A null text is empty; a null lang is the empty string; other columns go."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, part string, " + SCHEMA)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, pattern, n, good, toxic``: documents by what they fail (bits 1 to 16 for A to E),
    and how many of them ``labels`` (doc_id, quality, toxic) call good and toxic.

    A text fails E if the same text has a smaller doc_id. A document without id comes after all
    others: it fails E beside any row with an id, and never makes one fail. Rows of equal doc_id
    do not make each other fail. Several labels of one doc_id: any 1 counts.
    """
    fails = sum((F.when(test, _bit(letter)).otherwise(0) for letter, test in (
        ("A", F.col("n_words") < 200), ("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")),
        ("C", 100 * F.col("n_capitals") > 3 * F.col("n_points")), ("D", F.col("n_symbols") > 0))),
        F.lit(0))
    # copies with all the same are one row with a count, so that no text is a large group
    rows = stage(measure(docs).groupBy("digest", "doc_id", "part", fails.alias("fails"))
                 .agg(F.count(F.lit(1)).alias("n")), "measures")
    # the first of a text is found by a combined minimum and met by (text, doc_id): even keys
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = rows.where("doc_id is not null").join(
        first.withColumn("_first", F.lit(True)), ["digest", "doc_id"], "left").join(
        known, "doc_id", "left").select(
        "part", "fails", "n", F.col("_first").isNull().alias("late"), "good", "toxic")
    # rows without id: one row a text, part and pattern
    nameless = rows.where("doc_id is null").join(
        first.select("digest", F.lit(True).alias("_first")), "digest", "left").select(
        "part", "fails", "n", F.col("_first").isNotNull().alias("late"),
        F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    pattern = F.col("fails") + F.when(F.col("late"), _bit("E")).otherwise(0)
    return named.unionByName(nameless).groupBy("part", pattern.alias("pattern")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
                                 for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes at every step of every order, for each part.

    ``part, filter_order, step`` and the counts ``kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; zeros included. An empty table gives an empty result.
    """
    found = patterns(docs, labels)
    slots = 1 << len(FILTERS)
    # 32 numbers a part; then 600 rows a part, each from those numbers
    tables = found.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("pattern") == p, F.col(c))), F.lit(0))
                  for p in range(slots)]).alias(f"_{c}") for c in ("n", "good", "toxic")])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = tables.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(text: Column) -> Column:
        return sum((F.when(F.instr(text, c) > 0, _bit(c)).otherwise(0) for c in FILTERS), F.lit(0))

    steps = steps.withColumns({
        "_own": bits(F.col("filter_order").substr(F.col("step"), F.lit(1))),
        "_before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("_own"), F.col("_before")

    def total(counts: str, test) -> Column:
        return sum((F.when(test(F.lit(p)), F.col(counts)[p]).otherwise(0) for p in range(slots)),
                   F.lit(0).cast("long"))

    def here(p: Column) -> Column:
        return (p.bitwiseAND(own) != 0) & (p.bitwiseAND(before) == 0)

    judged = steps.select(
        "part", "filter_order", "step", "_own",
        total("_n", lambda p: p.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("_n", here).alias("removed"),
        total("_n", lambda p: (p.bitwiseAND(own) != 0) & (p.bitwiseAND(before) != 0)).alias("redundant"),
        total("_n", lambda p: p == own).alias("unique_fails"),
        total("_good", here).alias("good_lost"), total("_toxic", here).alias("toxic_lost"))
    same = Window.partitionBy("part", "_own")  # 120 rows
    return judged.withColumn("shapley", F.sum("removed").over(same)).drop("_own")
