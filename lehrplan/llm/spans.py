"""Substring deduplication over runs of consecutive sentences.

From every sentence the shortest run of at least two sentences and 25 words, forwards and
backwards, is hashed; runs that start at every sentence slide over the whole text, and a
repeated passage is covered by runs that lie inside it. Hashes are grouped over the corpus with
their first place, the repeated ones are joined back, and every sentence inside a run that is
not the first of its kind is removed. A sentence of more than 25 words counts as several: it is
cut before the word that makes the least hash with the word before it, in every window of eight
words. So the words themselves choose the cuts, equal passages get equal ones but near their
ends, and a passage of 55 words is found wherever it stands in its sentence. (Where a window
holds its least hash twice, as in loops of few words, the first found is kept while it can be.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm import arrays as A
from lehrplan.sources.staging import stage

SENTENCES = 2
WORDS = 25
WINDOW = 8
_END = re.compile(r"[.!?。！？]+[\"')\]”»]*\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")


def _cuts(words: list[str], window: int = WINDOW) -> list[int]:
    """Words of a long sentence that begin a part: no part has more than ``window`` words."""
    values = [0, *(xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:]))]

    def least(first: int, stop: int) -> int:
        part = values[first:stop]
        return stop - 1 - part[::-1].index(min(part))

    at = least(1, 1 + window)
    out = [at]
    for k in range(1 + window, len(words)):
        if values[k] < values[at]:
            at = k
        elif k - at >= window:
            at = least(k - window + 1, k + 1)
        else:
            continue
        out.append(at)
    return out


def sentences(text: str, longest: int = WORDS) -> list[tuple[int, int, list[str]]]:
    """Start, end (code points, with the space behind) and words of all sentences of a text."""
    out = []
    at = 0
    for stop in [m.end() for m in _END.finditer(text)] + [len(text)]:
        words = text[at:stop].split()
        if not words:
            if out and stop > at:
                out[-1] = (out[-1][0], stop, out[-1][2])
                at = stop
            continue
        if len(words) <= longest:
            out.append((at, stop, words))
        else:
            ends = [m.end() for m in _WORD.finditer(text, at, stop)]
            cuts = [0, *_cuts(words, min(longest, WINDOW)), len(words)]
            for first, last in zip(cuts, cuts[1:]):
                end = stop if last == len(words) else ends[last - 1]
                out.append((at, end, words[first:last]))
                at = end
        at = stop
    return out


def runs(counts: list[int], least: int = SENTENCES, words: int = WORDS) -> set[tuple[int, int]]:
    """Shortest runs [i, j) of at least ``least`` sentences and ``words`` words from every
    sentence forwards and backwards."""
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    found = set()
    j = 0
    for i in range(len(counts)):
        j = max(j, i + least)
        while j < len(counts) and total[j] - total[i] < words:
            j += 1
        if j > len(counts) or total[j] - total[i] < words:
            break
        found.add((i, j))
    i = len(counts)
    for j in range(len(counts), 0, -1):
        i = min(i, j - least)
        while i > 0 and total[j] - total[i] < words:
            i -= 1
        if i < 0 or total[j] - total[i] < words:
            break
        found.add((i, j))
    return found


def _hash(batches: Iterator[pa.RecordBatch], least: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = A.column(batch, "doc_id"), A.column(batch, "text")
        for start in range(0, batch.num_rows, 256):
            names, docs, firsts, counts = [], [], [], []
            for doc, text in zip(ids.slice(start, 256).to_pylist(),
                                 texts.slice(start, 256).to_pylist()):
                if not text:
                    continue
                parts = [s[2] for s in sentences(text)]
                each = [xxhash.xxh3_64_digest(" ".join(p)) for p in parts]
                for i, j in runs([len(p) for p in parts], least, words):
                    value = xxhash.xxh3_64_intdigest(b"".join(each[i:j]))
                    names.append(value - (1 << 64) if value >> 63 else value)
                    docs.append(doc)
                    firsts.append(i)
                    counts.append(j - i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(docs, pa.int64()),
                 pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())],
                ["run", "doc", "first", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans = (A.column(batch, c) for c in ("doc_id", "text", "runs"))
        for start in range(0, batch.num_rows, 256):
            total, removed, kept = [], [], []
            for text, own in zip(texts.slice(start, 256).to_pylist(),
                                 spans.slice(start, 256).to_pylist()):
                parts = sentences(text or "")
                gone = {k for s in own or () for k in range(s["first"], s["first"] + s["n"])}
                gone = {k for k in gone if k < len(parts)}
                total.append(len(parts))
                removed.append(len(gone))
                kept.append(None if text is None else text if not gone else "".join(
                    text[a:b] for k, (a, b, _) in enumerate(parts) if k not in gone))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, 256), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])


def repeated_runs(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``doc, first, n``: runs of sentences that also occur earlier (doc_id, then place)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                    "text")
    every = stage(texts.mapInArrow(partial(_hash, least=least, words=words),
                                   "run long, doc long, first int, n int"), "runs")
    place = F.struct("doc", "first")
    repeated = stage(every.groupBy("run").agg(F.min(place).alias("lead"), F.max(place).alias("last"))
                     .where("lead <> last").select("run", "lead"), "repeated")
    return every.join(repeated, "run").where(place != F.col("lead")).select("doc", "first", "n")


def remove_repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept`` for every row of ``docs`` (doc_id, text).

    ``kept`` is the text without its removed sentences (null for a null text). Texts shorter
    than a run lose nothing. A doc_id that occurs twice is one document: its rows are no repeats
    of each other. Rows without doc_id keep their text. An empty table gives an empty result.
    """
    own = repeated_runs(docs, least, words).groupBy("doc").agg(
        F.collect_set(F.struct("first", "n")).alias("runs"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (texts.join(own, F.col("doc_id") == F.col("doc"), "left")
            .select("doc_id", "text", "runs")
            .mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, kept string"))
