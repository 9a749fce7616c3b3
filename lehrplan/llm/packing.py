"""Best-fit packing planned over a histogram of lengths.

Only the number of pieces of each length (at most the capacity, so a bounded table) reaches the
driver. Best-fit in decreasing order runs over these counts: bins that hold the same lengths are
one entry with a multiplicity, so the plan costs the same for a thousand and for a trillion
documents. Every length gets runs of planned slots; a piece takes the slot at its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm.bpe import Pieces, encoded_blocks
from lehrplan.llm.pretokens import class_table, classes
from lehrplan.operators.ordering import positions
from lehrplan.sources.staging import stage

CAPACITY = 1024
SEPARATOR = 2
_ENCODERS: dict = {}


def _letters() -> str:
    """Byte-level vocabularies write a byte as a character of its own: printable ones as
    themselves, the others from U+0100 on in rising order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


LETTERS = _letters()


class _Encoder:
    """Token ids of whole texts as the ``tokenizers`` library gives them.

    Byte-level BPE encodes each pre-token by itself: they are found over whole arrays, and the
    library's model gets those never seen before. Texts that hold an added token of the vocabulary, which
    the library looks for first, go to it whole, as all texts do where it cuts them otherwise.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Spark task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cut = told["pre_tokenizer"] or {}
        self.by_pieces = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                          and not cut["add_prefix_space"] and not told["normalizer"])
        self.added = [t["content"] for t in told["added_tokens"]]
        self.pieces = Pieces(self._new)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens go to the library's model, in its letters for bytes."""
        ids, count, tokenize = array("i"), array("q"), self.tokenizer.model.tokenize
        letters, at = b"".join(pieces).decode("latin-1").translate(LETTERS), 0
        for piece in pieces:
            found = tokenize(letters[at:at + len(piece)])
            ids.extend([t.id for t in found])
            count.append(len(found))
            at += len(piece)
        return np.frombuffer(ids, np.int32), np.frombuffer(count, np.int64)

    def __call__(self, texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First row and the ids of every row, block by block."""
        texts = pc.fill_null(texts, "")
        apart = pc.invert(pc.equal(texts, texts)) if self.by_pieces else pc.equal(texts, texts)
        for content in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, content))
        for first, ids, bounds in encoded_blocks(pc.if_else(apart, "", texts), table, self.pieces):
            rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in np.flatnonzero(apart.slice(first, len(rows)).to_numpy(zero_copy_only=False)):
                rows[i] = self.whole([texts[first + int(i)].as_py()])[0]
            yield first, rows


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, compressed: bytes, capacity: int,
            keep_ids: bool) -> Iterator[pa.RecordBatch]:
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = _Encoder(tokenizer)
    encode, table = _ENCODERS[tokenizer], classes(compressed)
    for batch in batches:
        ids = batch.column(0)
        for first, texts in encode(batch.column(1), table):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, tokens in enumerate(texts):
                tokens = np.append(tokens, np.int32(SEPARATOR)).astype("<i4")
                total, begin, number = len(tokens), 0, 0
                while begin < total:
                    stop = begin + ((total - begin - 1) % capacity) + 1
                    own = tokens[begin:stop]
                    rows.append(first + i)
                    piece.append(number)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(own))
                    if keep_ids:
                        kept.append(own)
                    begin, number = stop, number + 1
            out = [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                   pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document, each text followed by the separator.

    A document of at most ``capacity`` ids is one piece; a longer one is cut so that all pieces
    but the first are full. Null and empty texts hold the separator alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_pieces, tokenizer=tokenizer, compressed=class_table(), capacity=capacity,
                keep_ids=keep_ids),
        schema + (", ids array<int>" if keep_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts: runs of slots (length, first rank, bins, per bin, first bin, offset).

    A run gives its slots bin by bin: ``per bin`` slots lie one after the other from ``offset``
    in each of ``bins`` bins. Bins are numbered from 0 without gaps.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left: [(first bin, bins)]
    spaces: list[int] = []
    opened = 0

    def put(space: int, first: int, bins: int) -> None:
        if space not in room:
            room[space] = []
            spaces.append(space)
            spaces.sort()
        room[space].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)  # the fullest bins that still have room
            if at < len(spaces):
                space = spaces[at]
                first, bins = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            else:
                space, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            per = min(space // length, left)
            full = min(bins, left // per)
            runs.append((length, rank, full, per, first, capacity - space))
            rank, left = rank + full * per, left - full * per
            if space > per * length:
                put(space - per * length, first, full)
            if full < bins:
                if left and left < per:  # the rest of this length goes to one more such bin
                    runs.append((length, rank, 1, left, first + full, capacity - space))
                    if space > left * length:
                        put(space - left * length, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                if full < bins:
                    put(space, first + full, bins - full)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, others kept).

    Pieces of one length are interchangeable and are ranked by (doc_id, piece, start); repeated
    rows take slots of their own. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    kept = stage(cut, "pieces")
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    # at most a few runs for each length up to the capacity: bounded by the capacity alone
    runs = spark.createDataFrame(plan(counts, capacity), "length long, _rank long, _bins long, "
                                 "_per long, _bin long, _offset long")
    table = runs.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("_rank", "_bins", "_per", "_bin", "_offset"))).alias("_runs"))
    ranked = positions(kept, [F.col("doc_id").asc_nulls_first(), F.col("piece").asc(),
                              F.col("start").asc(), F.col("ids_crc32").asc()],
                       keep=[c for c in kept.columns if c != "length"], by=["length"],
                       label="lengths")
    found = ranked.join(F.broadcast(table), "length").withColumn(
        "_run", F.expr("element_at(filter(_runs, r -> r._rank <= position), -1)"))
    rank = F.col("position") - F.col("_run._rank")
    return found.select(
        *[F.col(c) for c in kept.columns],
        (F.col("_run._bin") + F.floor(rank / F.col("_run._per"))).cast("long").alias("sequence_id"),
        (F.col("_run._offset") + rank % F.col("_run._per") * F.col("length")).cast("long")
        .alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences of pieces that carry their ids.

    A sequence holds at most the capacity, so a group is bounded.
    """
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))),
                              lambda s: s["ids"])).alias("ids"))
