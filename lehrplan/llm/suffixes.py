"""Exact removal of repeated byte strings with a logarithmic family of sampled suffix arrays.

Documents arrive in batches of rising doc_id. Every string of ``width`` bytes owns one anchor,
the position of the least 32-byte gram inside it; equal strings therefore own equal anchors, and
a document has about one anchor in 35 bytes. The suffixes that begin at anchors, ordered by the
fingerprint of their first gram and then of the whole stretch of strings that own them, are the
batch's suffix array, cut into buckets of equal fingerprint range. A new array is merge-scanned
against the array of every level; then it becomes a level itself, and levels of equal size merge
first when the next batch arrives, so n batches leave about log2(n) levels.

A suffix whose stretch equals an earlier one is a repeat as a whole. Where a gram has several
stretches, the strings themselves are compared: the stretches of a gram meet in one task, unless
a gram has very many, whose strings are dealt by their own fingerprints. Repeats are collapsed
before every shuffle, so a passage that a third of all documents hold costs one row per task.
Whole stretches are equal if the 64 bits of their gram and 64 bits of all their bytes, their
length and the anchor's place in them are (two unequal ones of one gram in 10**19 pairs pass for
equal); strings that are compared one by one are equal if their bytes are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm import arrays as A
from lehrplan.sources.staging import stage, staging_path

WIDTH = 100
GRAM = 32
CHUNK = 1 << 18          # anchors that a task orders at a time
FEW = 64                 # stretches of a gram in a chunk beyond which strings are compared at once
GATHERED = 4096          # stretches of a gram beyond which its strings are dealt one by one
BATCHES = 4
ARRAY, OPEN, REPEAT = 0, 1, 2

# an anchor: gram, stretch, document, place, strings before the anchor, strings, known as open
FIELDS = [("gram", "<u8"), ("stretch", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("back", "u1"),
          ("n", "u1"), ("open", "u1")]
SPAN = [("doc", "<i8"), ("start", "<i4"), ("end", "<i4")]
PACKED = "bucket int, kind int, rows binary"


def _pack(rows: dict[str, np.ndarray], fields) -> bytes:
    """Columns one after the other, wide ones as byte planes, which compress well."""
    n = len(rows[fields[0][0]])
    parts = [np.uint32(n).tobytes()]
    for name, kind in fields:
        flat = np.ascontiguousarray(rows[name].astype(kind)).view(np.uint8).reshape(n, -1)
        parts.append(flat.T.tobytes())
    return b"".join(parts)


def _cut(rows: dict, fields, size: int = 1 << 14) -> Iterator[bytes]:
    """Packed rows in parts of bounded size."""
    for i in range(0, len(rows["doc"]), size):
        yield _pack(_take(rows, slice(i, i + size)), fields)


def _unpack(blobs: list[bytes], fields) -> dict[str, np.ndarray]:
    out: dict[str, list] = {name: [] for name, _ in fields}
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for name, kind in fields:
            wide = np.dtype(kind).itemsize
            flat = np.frombuffer(blob, np.uint8, n * wide, at).reshape(wide, n)
            out[name].append(np.ascontiguousarray(flat.T).view(kind).ravel())
            at += n * wide
    return {name: np.concatenate(out[name]) if out[name] else np.zeros(0, kind)
            for name, kind in fields}


def _take(rows: dict, where) -> dict:
    return {k: v[where] for k, v in rows.items()}


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    n = len(values)
    fill = np.full(-n % size, np.iinfo(np.uint64).max, np.uint64)
    table = np.concatenate([values, fill]).reshape(-1, size)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - size + 1], ahead[size - 1:n])


def anchors(block: A.Block, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of all rows of a block; ``doc`` is the row in the block, places are in its text."""
    data, n = block.data, len(block.data)
    if n < width:
        return {name: np.zeros(0, kind) for name, kind in FIELDS}
    sums, power = block.prefix(A.VALUES[data]), A.powers(A.BASE, n + 1)
    grams = A.mix((sums[gram:] - sums[:-gram]) * power[:n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    ranked = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    least = _least(ranked, width - gram + 1)
    at = (low - (least & low)).astype(np.int64)
    row = np.repeat(np.arange(block.rows), np.diff(block.offsets))[:len(at)]
    whole = np.arange(len(at)) + width <= block.offsets[row + 1]
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(whole & change[:-1])
    ends = change[1:].copy()
    ends[:-1] |= ~whole[1:]
    last = np.flatnonzero(whole & ends)
    place = at[first]
    shape = ((last - first) * 256 + (place - first)).astype(np.uint64)
    stretch = A.mix((sums[last + width] - sums[first]) * power[first] ^ A.mix(shape))
    # anchors are least fingerprints; mixed again, they spread evenly over the buckets
    return {"gram": A.mix(grams[place] ^ A.BASE), "stretch": stretch, "doc": row[first],
            "at": place - block.offsets[row[first]], "back": place - first,
            "n": last - first + 1, "open": np.zeros(len(first), np.uint8)}


def _ordered(rows: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """Rows in array order, with marks of new grams and of new stretches."""
    rows = _take(rows, np.lexsort((rows["at"], rows["doc"], rows["stretch"], rows["gram"])))
    gram = np.ones(len(rows["gram"]), bool)
    gram[1:] = rows["gram"][1:] != rows["gram"][:-1]
    stretch = gram.copy()
    stretch[1:] |= rows["stretch"][1:] != rows["stretch"][:-1]
    return rows, gram, stretch


def _repeats(rows: dict, stretch: np.ndarray, width: int) -> dict:
    """Whole stretches that equal an earlier one; a repeated row is not its own repeat."""
    if not len(stretch):
        return {name: np.zeros(0, kind) for name, kind in SPAN}
    lead = np.flatnonzero(stretch)[np.cumsum(stretch) - 1]
    again = ~stretch & ((rows["doc"] != rows["doc"][lead]) | (rows["at"] != rows["at"][lead]))
    start = rows["at"].astype(np.int64) - rows["back"]
    end = start + rows["n"] + (width - 1)
    return {"doc": rows["doc"][again], "start": start[again], "end": end[again]}


def _chunk(rows: dict, buckets: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """The packed rows of one chunk of anchors."""
    rows, gram, stretch = _ordered(rows)
    spans = _repeats(rows, stretch, width)
    lone = _take(rows, stretch)
    group = np.cumsum(gram[stretch]) - 1
    count = np.bincount(group)
    many = count[group] > FEW
    sure = _take(lone, many)
    lone["open"] = np.where(count[group] > 1, 1, lone["open"]).astype(np.uint8)
    keep = ~many
    keep[np.flatnonzero(gram[stretch])] = True  # one row tells the others that the gram is open
    lone = _take(lone, keep)
    bucket = (lone["gram"].astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    spread = int(rows["gram"][0] % np.uint64(buckets)) if len(rows["gram"]) else 0
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, ARRAY, _pack(_take(lone, slice(cuts[b], cuts[b + 1])), FIELDS)
    for kind, part, fields in ((OPEN, sure, FIELDS), (REPEAT, spans, SPAN)):
        for blob in _cut(part, fields):
            spread = (spread + 1) % buckets
            yield spread, kind, blob


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "rows"])


def _index(batches: Iterator[pa.RecordBatch], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0

    def out():
        rows = {name: np.concatenate([h[name] for h in held]) for name, _ in FIELDS}
        held.clear()
        return _batch(list(_chunk(rows, buckets, width)))

    for batch in batches:
        ids = A.column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for block in A.blocks(A.column(batch, "text"), A.BLOCK_BYTES // 4):
            rows = anchors(block, width)
            rows["doc"] = ids[block.first + rows["doc"]]
            held.append({name: rows[name].astype(kind) for name, kind in FIELDS})
            size += len(rows["doc"])
            if size >= CHUNK:
                yield out()
                size = 0
    if size:
        yield out()


def _scan(new: pa.Table, level: pa.Table | None, width: int) -> pa.Table:
    """Merge one bucket of a batch with the same bucket of a level.

    Returns the batch's array without what the level knows, and what the scan found. Every row
    of the level comes before every row of the batch.
    """
    def blobs(table: pa.Table | None, kind: int) -> list[bytes]:
        if table is None:
            return []
        return [r for k, r in zip(table["kind"].to_pylist(), table["rows"].to_pylist())
                if k == kind]

    bucket = (new if new.num_rows else level)["bucket"][0].as_py()
    passed = [(bucket, kind, r) for kind in (OPEN, REPEAT) for r in blobs(new, kind)]
    fresh, old = _unpack(blobs(new, ARRAY), FIELDS), _unpack(blobs(level, ARRAY), FIELDS)
    mine = np.r_[np.zeros(len(old["doc"]), bool), np.ones(len(fresh["doc"]), bool)]
    rows = {name: np.concatenate([old[name], fresh[name]]) for name, _ in FIELDS}
    rows["mine"] = mine
    rows, gram, stretch = _ordered(rows)
    if not mine.any():
        return pa.Table.from_batches([_batch(passed)])
    lead = np.flatnonzero(stretch)[np.cumsum(stretch) - 1]
    own = rows["mine"]
    # a batch may repeat only itself or the level: rows of the level lead or repeat nothing
    again = _repeats(_take(rows, own | stretch), stretch[own | stretch], width)
    lone = _take(rows, stretch)
    group = np.cumsum(gram[stretch]) - 1
    several = np.bincount(group)[group] > 1
    # marks may stand in rows that equal an older one, which heads their stretch
    every = np.cumsum(gram) - 1
    flagged = np.bincount(every, weights=rows["open"])[group] > 0
    is_open = several | flagged
    theirs = np.bincount(group, weights=~lone["mine"])[group]
    known = np.bincount(group, weights=lone["open"] * ~lone["mine"])[group]
    mixed = np.bincount(every, weights=rows["mine"])[group] > 0
    emit = is_open & np.where(lone["mine"], True, mixed & (theirs == 1) & (known == 0))
    lone["open"] = np.where(is_open, 1, lone["open"]).astype(np.uint8)
    found = [(bucket, kind, blob) for kind, part, fields in
             ((OPEN, _take(lone, emit), FIELDS), (REPEAT, again, SPAN),
              (ARRAY, _take(lone, lone["mine"]), FIELDS)) for blob in _cut(part, fields)]
    return pa.Table.from_batches([_batch(passed + found)])


def _merge(left: pa.Table, right: pa.Table) -> pa.Table:
    """One bucket of two levels as one array."""
    tables = [t for t in (left, right) if t.num_rows]
    rows = _unpack([r for t in tables for r in t["rows"].to_pylist()], FIELDS)
    rows, _, stretch = _ordered(rows)
    bucket = tables[0]["bucket"][0].as_py()
    return pa.Table.from_batches([_batch([(bucket, ARRAY, blob) for blob in
                                          _cut(_take(rows, stretch), FIELDS)])])


class SuffixLevels:
    """The index: levels of suffix arrays, each a table bucketed by fingerprint range."""

    def __init__(self, spark, buckets: int | None = None, width: int = WIDTH):
        self.spark, self.width = spark, width
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []  # (batches merged, array rows), oldest first
        self.names: list[str] = []

    def _store(self, rows: DataFrame) -> DataFrame:
        name = f"suffix_level_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "bucket")
         .option("path", staging_path(self.spark, "suffix-level")).saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the tables out of the catalog; their files go with the staging folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], []

    def append(self, docs: DataFrame) -> DataFrame:
        """Add documents that follow all earlier ones by doc_id; what they repeat, packed."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, right), (_, left) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._store(
                left.groupBy("bucket").cogroup(right.groupBy("bucket"))
                .applyInArrow(_merge, PACKED))))
        rows = docs.mapInArrow(partial(_index, buckets=self.buckets, width=self.width), PACKED)
        width = self.width
        if not self.levels:
            rows = rows.groupBy("bucket").applyInArrow(lambda t: _scan(t, None, width), PACKED)
        for _, level in self.levels:
            rows = rows.groupBy("bucket").cogroup(level.groupBy("bucket")).applyInArrow(
                lambda new, old: _scan(new, old, width) if new.num_rows else
                pa.Table.from_batches([_batch([])]), PACKED)
        kept = self._store(rows)
        self.levels.append((1, kept.where(f"kind = {ARRAY}")))
        return kept.where(f"kind <> {ARRAY}")


def _decode(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    fields = SPAN if kind == REPEAT else FIELDS
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            rows = _unpack([blob], fields)
            if kind == REPEAT:
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(t)) for c, t in
                                                  (("doc", "i8"), ("start", "i4"), ("end", "i4"))],
                                                 ["doc", "start", "end"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(rows["gram"].copy())), pa.array(rows["doc"]),
                     pa.array(rows["at"]), pa.array(rows["back"].astype("i4")),
                     pa.array(rows["n"].astype("i4"))], ["gram", "doc", "at", "back", "n"])


def _strings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of open stretches, dealt by gram, and single strings of grams with very many.

    Rows: key, document, place of the first string, bytes; without bytes a repeat found here.
    """
    codec = pa.Codec("zstd")
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        keys, docs, places, texts = [], [], [], []
        loose: dict[bytes, tuple[int, int]] = {}
        again: list[tuple[int, int]] = []
        for doc, packed, size, stretches in zip(*(A.column(batch, c).to_pylist() for c in
                                                  ("doc", "packed", "size", "open"))):
            text = codec.decompress(packed, size).to_pybytes()
            for one in stretches:
                start, n = one["at"] - one["back"], one["n"]
                if start < 0 or start + n + width - 1 > len(text):
                    continue  # rows that share a doc_id but not a text
                if not one["many"]:
                    keys.append(one["gram"])
                    docs.append(doc)
                    places.append(start)
                    texts.append(text[start:start + n + width - 1])
                    continue
                for p in range(start, start + n):
                    name = text[p:p + width]
                    if name not in loose:
                        loose[name] = (doc, p)
                    elif loose[name] > (doc, p):
                        again.append(loose[name])
                        loose[name] = (doc, p)
                    elif loose[name] != (doc, p):
                        again.append((doc, p))
        for name, (doc, p) in loose.items():
            keys.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little",
                                       signed=True))
            docs.append(doc)
            places.append(p)
            texts.append(name)
        for doc, p in again:
            keys.append((doc + p) % 1_000_003)
            docs.append(doc)
            places.append(p)
            texts.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()),
                                          pa.array(places, pa.int32()), pa.array(texts, pa.binary())],
                                         ["key", "doc", "start", "bytes"])


def _compare(docs: np.ndarray, starts: np.ndarray, texts: list[bytes], width: int) -> np.ndarray:
    """(document, place) of every string that occurs earlier in these stretches."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    block = A.Block(0, np.frombuffer(b"".join(texts), np.uint8), offsets)
    sums = block.prefix(A.VALUES[block.data])
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    at = np.arange(len(row))
    inside = at + width <= offsets[row + 1]
    at, row = at[inside], row[inside]
    name = A.mix((sums[at + width] - sums[at]) * A.powers(A.BASE, len(block.data) + 1)[at])
    name = A.first_equal(block.data, at, at + width, name)  # equal bytes, not only equal hashes
    doc, place = docs[row], starts[row] + (at - offsets[row])
    order = np.lexsort((place, doc, name))
    name, doc, place = name[order], doc[order], place[order]
    head = np.ones(len(name), bool)
    head[1:] = name[1:] != name[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[lead]) | (place != place[lead])
    return np.stack([doc[later], place[later]], axis=1)


def _resolve(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings; the rows of a partition come ordered by key."""
    def spans(hits: np.ndarray) -> pa.RecordBatch:
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] > hits[:-1, 1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hits)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(hits[first, 0]), pa.array(hits[first, 1].astype(np.int32)),
             pa.array((hits[last, 1] + width).astype(np.int32))], ["doc", "start", "end"])

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = [r for r in rows if r[3] is not None]
        sure = np.array([(r[1], r[2]) for r in rows if r[3] is None], np.int64).reshape(-1, 2)
        if known:
            sure = np.concatenate([sure, _compare(np.array([r[1] for r in known], np.int64),
                                                  np.array([r[2] for r in known], np.int64),
                                                  [r[3] for r in known], width)])
        if len(sure):
            yield spans(sure)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= 4096 and row[0] != held[-1][0]:
                yield from done(held)
                held = []
            held.append(row)
    yield from done(held)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            raw = [(t or "").encode() for t in batch.column(1).slice(first, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, 512),
                 pa.array([codec.compress(t).to_pybytes() for t in raw], pa.binary()),
                 pa.array([len(t) for t in raw], pa.int32())], ["doc", "packed", "size"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        out: list[tuple] = []
        for doc, packed, size, spans in zip(*(A.column(batch, c).to_pylist() for c in
                                              ("doc", "packed", "size", "spans"))):
            text = codec.decompress(packed, size).to_pybytes()
            runs: list[list[int]] = []
            for one in sorted((s["start"], s["end"]) for s in spans or ()):
                if runs and one[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], min(one[1], size))
                elif one[0] < size:
                    runs.append([one[0], min(one[1], size)])
            kept, at = [], 0
            for start, end in runs:
                kept.append(text[at:start])
                at = end
            kept.append(text[at:])
            whole = b"".join(kept)
            out.append((doc, size, size - len(whole), runs, whole))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
             pa.array([r[2] for r in out], pa.int64()),
             pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in out],
                      pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array([r[4] for r in out], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Documents cut by doc_id into parts of about equal numbers."""
    if batches < 2:
        return [docs]
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > int(low))
        if high is not None:
            part = part.where(F.col("doc_id") <= int(high))
        parts.append(part)
    return parts


def repeated_spans(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """``doc, start, end``: byte spans (maybe overlapping) of strings of ``width`` bytes that
    also start earlier; together they cover every byte of such a string and no other."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                    "text")
    index = SuffixLevels(spark, width=width)
    long_enough = texts.where(F.octet_length("text") >= width)
    found = [index.append(part) for part in _batches(long_enough, batches)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    whole = rows.where(f"kind = {REPEAT}").select("rows").mapInArrow(
        partial(_decode, kind=REPEAT), "doc long, start int, end int")
    pending = stage(rows.where(f"kind = {OPEN}").select("rows").mapInArrow(
        partial(_decode, kind=OPEN), "gram long, doc long, at int, back int, n int")
        .dropDuplicates(["doc", "at"]), "open")
    many = stage(pending.groupBy("gram").count().where(f"count > {GATHERED}").select("gram"), "many")
    marked = pending.join(many.withColumn("many", F.lit(True)), "gram", "left").select(
        "doc", F.struct("at", "back", "n", "gram", F.coalesce("many", F.lit(False)).alias("many"))
        .alias("one"))
    by_doc = marked.groupBy("doc").agg(F.collect_list("one").alias("open"))
    packed = long_enough.mapInArrow(_texts, "doc long, packed binary, size int")
    pieces = (packed.join(by_doc, "doc").select("doc", "packed", "size", "open")
              .mapInArrow(partial(_strings, width=width),
                          "key long, doc long, start int, bytes binary"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = (pieces.repartition(parts, "key").sortWithinPartitions("key")
              .mapInArrow(partial(_resolve, width=width), "doc long, start int, end int"))
    spans = stage(whole.unionByName(single), "spans")
    index.forget()
    return spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row of ``docs`` (doc_id, text).

    ``spans`` are the maximal removed runs, ``kept`` the bytes that stay. A null or empty text
    has nothing to remove. A doc_id that occurs twice is one document: its rows are no repeats
    of each other. Rows without doc_id keep all bytes and repeat nothing. An empty table gives
    an empty result.
    """
    spans = repeated_spans(docs, width, batches).groupBy("doc").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _texts, "doc long, packed binary, size int")
    return (texts.join(spans, "doc", "left").select("doc", "packed", "size", "spans")
            .mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, "
                               "spans array<struct<start:long,end:long>>, kept binary"))
