"""Benchmark decontamination over a distributed positional inverted index.

The corpus is counted for the words of the test items. In every window of ten item words the
two rarest words are looked up: the index stores the postings (word, document, position) of
these words, and lists shifted by the words' offsets are intersected by document, item and
shift. What remains is compared word by word, so matches are exact.

Words are maximal runs of digits, letters and everything above ASCII, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lehrplan.llm import arrays as A
from lehrplan.sources.staging import stage

WINDOW = 10
ITEM_WORDS = 1 << 20  # words of test items that travel with a task; more go in several rounds


@dataclass
class Items:
    """Test items of one round: words, bounds and ids; one entry for every row with words."""

    words: np.ndarray
    bounds: np.ndarray
    ids: list[int]

    def __post_init__(self):
        self.vocabulary = np.unique(self.words)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in A.blocks(A.column(batch, "text")):
            _, _, row, word = block.words()
            cuts = np.searchsorted(row, np.arange(block.rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(A.signed(word)))
            yield pa.RecordBatch.from_arrays(
                [A.column(batch, "item_id").slice(block.first, block.rows), lists],
                ["item_id", "words"])


def item_rounds(benchmark: DataFrame, limit: int = ITEM_WORDS) -> Iterator[Items]:
    """Test items in rounds of at most ``limit`` words (or one item); one round in memory."""
    split = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                  .where("item_id is not null and text is not null")
                  .mapInArrow(_item_words, "item_id long, words array<long>")
                  .where(F.size("words") > 0), "items")
    total = split.agg(F.sum(F.size("words"))).first()[0] or 0
    rounds = -(-2 * total // limit) if total > limit else 1
    for k in range(rounds):
        part = split.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(rounds)) == k)
        rows = sorted(part.toArrow().to_pylist(), key=lambda r: (r["item_id"], r["words"]))
        if rows:
            sizes = [len(r["words"]) for r in rows]
            words = np.concatenate([np.array(r["words"], np.int64) for r in rows]).view(np.uint64)
            yield Items(words, np.concatenate([[0], np.cumsum(sizes)]), [r["item_id"] for r in rows])


def _count(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        ids = A.column(batch, "doc_id")
        for block in A.blocks(A.column(batch, "text")):
            _, _, row, word = block.words()
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == word], minlength=len(vocabulary))
            n = np.bincount(row, minlength=block.rows)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.nulls(block.rows, pa.int64()), pa.array(n)],
                ["doc_id", "word", "n"])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()),
                                      pa.array(A.signed(vocabulary[used])), pa.array(total[used])],
                                     ["doc_id", "word", "n"])


def count_words(docs: DataFrame, items: Items) -> DataFrame:
    """Rows (doc_id, null, words of the row) and (null, item word, its share of the count)."""
    return docs.mapInArrow(partial(_count, vocabulary=items.vocabulary),
                           "doc_id long, word long, n long")


@dataclass
class Probes:
    """Places of items to look up: pairs of the rarest two places of every window."""

    pairs: dict[int, np.ndarray]  # row of the items: distinct pairs of places, shape (n, 2)


def probes(items: Items, counts: dict[int, int], window: int = WINDOW) -> Probes:
    """The rarest and second rarest place of every window; ties go to the earlier place."""
    signed = A.signed(items.words)
    rarity = np.array([counts.get(int(w), 0) for w in signed], np.int64)
    pairs = {}
    for k in range(len(items.ids)):
        a, b = items.bounds[k], items.bounds[k + 1]
        own = rarity[a:b]
        size = min(window, b - a)
        view = np.lib.stride_tricks.sliding_window_view(own, size)
        order = np.argsort(view, axis=1, kind="stable")
        two = order[:, [0, min(1, size - 1)]] + np.arange(len(view))[:, None]
        # a window with a word that no document holds occurs nowhere
        two = two[view.min(axis=1) > 0]
        if len(two):
            pairs[k] = np.unique(np.sort(two, axis=1), axis=0)
    return Probes(pairs)


def _post(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = A.column(batch, "doc_id").to_numpy(zero_copy_only=False)
        for block in A.blocks(A.column(batch, "text")):
            _, _, row, word = block.words()
            first = np.searchsorted(row, np.arange(block.rows))
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(A.signed(word[hit])), pa.array(ids[block.first + row[hit]], pa.int64()),
                 pa.array((hit - first[row[hit]]).astype(np.int32))], ["word", "doc_id", "position"])


def postings(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """The index: ``word, doc_id, position`` of the given words (sorted 64-bit hashes)."""
    return docs.mapInArrow(partial(_post, vocabulary=words),
                           "word long, doc_id long, position int")


def shifted(index: DataFrame, items: Items, look: Probes) -> DataFrame:
    """``doc_id, item, shift, place``: postings of item places, shifted to where the item's
    first word would stand."""
    rows = [(int(A.signed(items.words)[items.bounds[k] + p]), k, int(p))
            for k, pairs in look.pairs.items() for p in np.unique(pairs)]
    places = index.sparkSession.createDataFrame(rows, "word long, item int, place int")
    return index.join(places, "word").select("doc_id", "item", "place",
                                             (F.col("position") - F.col("place")).alias("shift"))


def phrase_candidates(lists: DataFrame, look: Probes) -> DataFrame:
    """``doc_id, item, shift`` where both rarest places of some window stand at one shift."""
    spark = lists.sparkSession
    pairs = spark.createDataFrame([(k, [[int(a), int(b)] for a, b in p])
                                   for k, p in look.pairs.items()],
                                  "item int, pairs array<array<int>>")
    met = lists.groupBy("doc_id", "item", "shift").agg(F.collect_set("place").alias("places"))
    return met.join(pairs, "item").where(
        F.exists("pairs", lambda p: F.array_contains("places", p[0]) &
                 F.array_contains("places", p[1]))).select("doc_id", "item", "shift")


def proximity(lists: DataFrame, look: Probes, slop: int) -> DataFrame:
    """``doc_id, item`` where both rarest places of some window stand as far apart as in the item, up
    to ``slop`` words more or less: their shifts differ by no more.

    The postings of a pair are laid out by shift, and each looks back to the last one of the other
    place, so nothing is multiplied; a group holds the postings of two words in one document.
    """
    rows = [(k, n, int(place), side) for k, pairs in look.pairs.items() for n, pair in enumerate(pairs)
            for side, place in enumerate(pair)]
    pairs = lists.sparkSession.createDataFrame(rows, "item int, pair int, place int, side int")
    order = (Window.partitionBy("doc_id", "item", "pair").orderBy("shift", "side")
             .rowsBetween(Window.unboundedPreceding, 0))
    last = [F.last(F.when(F.col("side") == side, F.col("shift")), ignorenulls=True).over(order)
            for side in (0, 1)]
    apart = F.col("shift") - F.when(F.col("side") == 0, last[1]).otherwise(last[0])
    return lists.join(pairs, ["item", "place"]).select("doc_id", "item", apart.alias("apart")).where(
        F.col("apart") <= slop).select("doc_id", "item").distinct()


def _compare(batches: Iterator[pa.RecordBatch], items: Items, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = A.column(batch, "wanted").to_pylist()
        ids, hit, found = [], [], []
        for block in A.blocks(A.column(batch, "text")):
            _, _, row, word = block.words()
            cuts = np.searchsorted(row, np.arange(block.rows + 1))
            for i in range(block.rows):
                own = word[cuts[i]:cuts[i + 1]]
                mark = np.zeros(len(own) + 1, np.int64)
                seen = set()
                for one in wanted[block.first + i]:
                    a, b = items.bounds[one["item"]], items.bounds[one["item"] + 1]
                    size = min(window, b - a)
                    low, high = max(0, -one["shift"]), min(b - a, len(own) - one["shift"])
                    if high - low < size:
                        continue
                    same = own[low + one["shift"]:high + one["shift"]] == items.words[a + low:a + high]
                    run = np.concatenate([[0], np.cumsum(same)])
                    starts = np.flatnonzero(run[size:] - run[:-size] == size) + low + one["shift"]
                    if len(starts):
                        seen.add(items.ids[one["item"]])
                        np.add.at(mark, starts, 1)
                        np.add.at(mark, starts + size, -1)
                if seen:
                    ids.append(block.first + i)
                    hit.append(np.flatnonzero(np.cumsum(mark[:-1]) > 0).astype(np.int32))
                    found.append(sorted(seen))
        yield pa.RecordBatch.from_arrays(
            [A.column(batch, "doc_id").take(pa.array(ids, pa.int64())),
             pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))],
            ["doc_id", "hits", "items"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 limit: int = ITEM_WORDS, slop: int | None = None) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every document of ``docs`` (doc_id, text).

    With ``slop`` also ``near``: the ids of items of which the two rarest words of some window stand in
    the document as far apart as in the item, up to ``slop`` words more or less.

    ``hits`` are the positions of words inside an occurrence of a window of an item of
    ``benchmark`` (item_id, text), ``items`` the sorted ids of those items. Null texts and
    texts without words have none. An item of fewer words than a window is one window; one
    without words, or without id, is none. A doc_id that occurs twice is matched row by row and
    its rows share what either holds; rows without doc_id match nothing. Empty tables give no
    hits.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.where("doc_id is not null and text is not null")
    parts, close = [], []
    lengths = None
    for items in item_rounds(benchmark, limit):
        counted = stage(count_words(texts, items), "counts")
        lengths = lengths if lengths is not None else counted.where("word is null")
        totals = counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
        look = probes(items, {r["word"]: r["n"] for r in totals.toArrow().to_pylist()}, window)
        if not look.pairs:
            continue
        words = np.unique(np.concatenate([items.words[items.bounds[k] + np.unique(p)]
                                          for k, p in look.pairs.items()]))
        index = stage(postings(named, words), "postings")
        lists = shifted(index, items, look)
        if slop is not None:
            ids = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
            close.append(stage(proximity(lists, look, slop).join(ids, "item").groupBy(
                F.col("doc_id").alias("_near_id")).agg(F.collect_set("item_id").alias("near")), "near"))
        wanted = stage(phrase_candidates(lists, look)
                       .groupBy("doc_id").agg(F.collect_list(F.struct("item", "shift"))
                                              .alias("wanted")), "wanted")
        parts.append(stage(named.join(wanted, "doc_id").select("doc_id", "text", "wanted")
                           .mapInArrow(partial(_compare, items=items, window=window),
                                       "doc_id long, hits array<int>, items array<long>"), "hits"))
    if lengths is None:
        nothing = Items(np.zeros(1, np.uint64), np.array([0]), [])
        lengths = stage(count_words(texts, nothing), "counts").where("word is null")
    empty = [F.array().cast("array<int>"), F.array().cast("array<long>")]
    none = [empty[1].alias("near")] if slop is not None else []
    if not parts:
        return lengths.where("n is not null").select(
            "doc_id", F.col("n").alias("n_words"), empty[0].alias("hits"), empty[1].alias("items"), *none)
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = lengths.join(merged, F.col("doc_id") == F.col("_id"), "left")
    if slop is not None:
        by_doc = reduce(DataFrame.unionByName, close).groupBy("_near_id").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        found = found.join(by_doc, F.col("doc_id") == F.col("_near_id"), "left")
        none = [F.coalesce("near", empty[1]).alias("near")]
    return found.select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("hits", empty[0]).alias("hits"),
        F.coalesce("items", empty[1]).alias("items"), *none)
