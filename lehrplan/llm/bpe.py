"""Byte-level BPE over text columns, and back.

Pre-tokens are found over whole arrays (``pretokens``), equal ones of a window are put together
in a table that compares their bytes, and only those never seen before are merged pair by pair;
merged ones are kept in a cache. Token ids come with the byte offset of every token in its text,
so any run of tokens can be decoded into its place. No shuffle; a task holds one window of text,
the cache and the ids of one batch.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm import pretokens
from lehrplan.llm.arrays import blocks, column, first_equal, mix, same_bytes, view64, words64

CACHED = 300_000  # pre-tokens kept; beyond that the cache starts anew
LONG = 64  # bytes from which pairs wait in a heap
DECODED = 1 << 18  # tokens decoded at once
NONE = np.iinfo(np.int64).max
_LOADED: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the leftmost pair of least rank is joined until none is left.
    Pairs wait in a heap and neighbours are linked, so n bytes take n log n steps."""
    n = len(piece)
    ends = array("q", range(1, n + 1))  # of the part that starts at i; 0: joined to the left
    left = array("q", range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        middle = ends[i]
        if middle < n and (r := ranks.get(piece[i:ends[middle]])) is not None:
            heapq.heappush(heap, (r, i, ends[middle]))

    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            left[end] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


class Tokens:
    """The bytes of every id of a ranks file."""

    def __init__(self, ranks: dict[bytes, int]):
        known = sorted((i, t) for t, i in ranks.items())
        self.sizes = np.zeros(known[-1][0] + 1, np.int64)
        self.sizes[[i for i, _ in known]] = [len(t) for _, t in known]
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(t for _, t in known), np.uint8)


class Vocabulary(Tokens):
    """The same with the ranks and a hash table of the pairs that join."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, rank = array("q"), array("q")
        for token, n in ranks.items():
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    pairs.append(ranks[token[:i]] << 32 | ranks[token[i:]])
                    rank.append(n)
        keys, joined = np.array(pairs, np.int64), np.array(rank, np.int64)
        self.mask = (1 << (2 * len(keys) + 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.joined = np.full(self.mask + 1, NONE, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]
            put = self.keys[slot[left]] == keys[left]
            self.joined[slot[left[put]]] = joined[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & self.mask
        self.pieces = Pieces(self.merge)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, which is the id, of the tokens joined; NONE where they do not join."""
        keys = a << 32 | b
        out = np.full(len(keys), NONE, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            held = self.keys[slot]
            found = held == keys[left]
            out[left[found]] = self.joined[slot[found]]
            on = ~found & (held != -1)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has.

        A piece that is a token is that token. The others step together: in every round each
        joins its leftmost pair of least rank; pieces without a pair leave. Long pieces go alone.
        """
        whole = [self.ranks.get(p, -1) for p in pieces]
        number, ids = [], []
        step = [i for i, (w, p) in enumerate(zip(whole, pieces)) if w < 0 and len(p) < LONG]
        owner = np.repeat(step, [len(pieces[i]) for i in step]).astype(np.int64)
        now = self.single[np.frombuffer(b"".join(pieces[i] for i in step), np.uint8)]
        rank = self._ranks(now, owner)
        while len(now):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(now))
            over = np.repeat(least == NONE, size)
            number.append(owner[over])
            ids.append(now[over])
            at = np.flatnonzero((rank == np.repeat(least, size)) & ~over)
            at = at[np.diff(owner[at], prepend=-1) != 0]
            now[at] = rank[at]
            stay = ~over
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            at = place[at]
            now, owner, rank = now[stay], owner[stay], rank[stay]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near] = self._ranks(now, owner, near)
        for i, (w, p) in enumerate(zip(whole, pieces)):
            if w < 0 and len(p) >= LONG:
                ids.append(np.array(merge_long(p, self.ranks), np.int64))
                number.append(np.full(len(ids[-1]), i))
        alone = np.flatnonzero(np.array(whole, np.int64) >= 0)
        number = np.concatenate([*number, alone])
        ids = np.concatenate([*ids, np.array(whole, np.int64)[alone]])
        order = np.argsort(number, kind="stable")
        return ids[order].astype(np.int32), np.bincount(number, minlength=len(pieces))

    def _ranks(self, now: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that begins at each place, NONE at the last place of a piece."""
        at = np.arange(len(now)) if at is None else at
        out = np.full(len(at), NONE, np.int64)
        inner = np.flatnonzero(at + 1 < len(now))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.pair(now[at[inner]], now[at[inner] + 1])
        return out


class Pieces:
    """Ids of pre-tokens, those met before from a cache; ``encode`` gives ids of new ones.

    The cache is an open hash table over the bytes of the pre-tokens it holds; a hash finds an
    entry and equal bytes confirm it.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 cached: int = CACHED):
        self.encode, self.cached = encode, cached
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << 16, -1, np.int32)
        self.hashes = np.zeros(0, np.uint64)
        self.text, self.places = np.zeros(8, np.uint8), np.zeros(1, np.int64)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              hashes: np.ndarray) -> np.ndarray:
        """Entry of every span, -1 for new ones."""
        entry = np.full(len(starts), -1, np.int64)
        here, held = words64(data), view64(self.text)
        left, slot = np.arange(len(starts)), (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(left):
            met = self.table[slot]
            on = met >= 0
            left, slot, met = left[on], slot[on], met[on]
            same = self.hashes[met] == hashes[left]
            sure = np.flatnonzero(same)
            own, other = left[sure], met[sure]
            length = lengths[own]
            good = self.places[other + 1] - self.places[other] == length
            good[good] = same_bytes(here, starts[own[good]], held, self.places[other[good]], length[good])
            entry[own[good]] = other[good]
            same[sure] = good
            left, slot = left[~same], (slot[~same] + 1) & (len(self.table) - 1)
        return entry

    def _put(self, entries: np.ndarray) -> None:
        slot = (self.hashes[entries] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(entries):
            free = self.table[slot] < 0
            self.table[slot[free]] = entries[free]
            on = self.table[slot] != entries
            entries, slot = entries[on], (slot[on] + 1) & (len(self.table) - 1)

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        raw, known = data.tobytes(), len(self.hashes)
        new = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        ids, count = self.encode(new)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])
        joined = np.frombuffer(b"".join(new) + bytes(8), np.uint8)
        self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(ends - starts)])
        self.text = np.concatenate([self.text[:-8], joined])
        self.hashes = np.concatenate([self.hashes, hashes])
        if 3 * len(self.hashes) > len(self.table):
            self.table = np.full(4 * len(self.table), -1, np.int32)
            known = 0
        self._put(np.arange(known, len(self.hashes), dtype=np.int32))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and how many each has."""
        if len(self.hashes) > self.cached or len(self.text) > 32 * self.cached:
            self.clear()
        lengths, hashes = ends - starts, pretokens.hashes(data, starts, ends)
        entry = self._find(data, starts, lengths, hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            owner = first_equal(data, starts[new], ends[new], hashes[new])
            own = np.flatnonzero(owner == np.arange(len(new)))
            number = np.zeros(len(new), np.int64)
            number[own] = len(self.hashes) + np.arange(len(own))
            entry[new] = number[owner]
            self._add(data, starts[new[own]], ends[new[own]], hashes[new[own]])
        first, count = self.bounds[entry], self.bounds[entry + 1] - self.bounds[entry]
        before = np.cumsum(count) - count
        return self.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))], count


def vocabulary(path: str) -> Vocabulary:
    if ("encode", path) not in _LOADED:
        _LOADED["encode", path] = Vocabulary(read_ranks(path))
    return _LOADED["encode", path]


def tokens_of(path: str) -> Tokens:
    if ("decode", path) not in _LOADED:
        _LOADED["decode", path] = Tokens(read_ranks(path))
    return _LOADED["decode", path]


def encoded_blocks(texts: pa.Array, table: np.ndarray, pieces: Pieces,
                   ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids of all rows, and the bounds of rows among them, for each block of texts."""
    for block in blocks(texts, pretokens.WINDOW):
        ids, done, tokens = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at = total = 0
        for data, starts, ends in pretokens.tokens(block, table):
            own, count = pieces(data, starts, ends)
            ids.append(own)
            done.append(at + ends)
            tokens.append(total + np.cumsum(count))
            at, total = at + len(data), total + len(own)
            if block.rows == 1:  # one long row: its end is its only bound
                done, tokens = [done[0], done[-1][-1:]], [tokens[0], tokens[-1][-1:]]
        place = np.searchsorted(np.concatenate(done), block.offsets)
        yield (block.first, np.concatenate(ids) if ids else np.zeros(0, np.int32),
               np.concatenate(tokens)[place])


def _encode(batches: Iterator[pa.RecordBatch], path: str, compressed: bytes) -> Iterator[pa.RecordBatch]:
    known, table = vocabulary(path), pretokens.classes(compressed)
    for batch in batches:
        for first, ids, bounds in encoded_blocks(column(batch, "text"), table, known.pieces):
            sizes = known.sizes[ids]
            offsets = np.cumsum(sizes) - sizes
            own = np.append(offsets, 0)[np.minimum(bounds[:-1], len(offsets))]
            offsets = (offsets - np.repeat(own, np.diff(bounds))).astype(np.int32)
            rows = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").slice(first, len(bounds) - 1),
                 pa.ListArray.from_arrays(rows, pa.array(ids)),
                 pa.ListArray.from_arrays(rows, pa.array(offsets))], ["doc_id", "ids", "offsets"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, offsets``: the token ids of every whole text by the ranks file ``path``, as
    the tiktoken library's ``encode_ordinary`` gives them, and where each token starts in the
    UTF-8 bytes of the text.

    Null and empty texts have no tokens. Repeated and null ids are rows like any other; columns
    but ``doc_id`` and ``text`` are ignored. An empty table gives an empty result. A long text is
    read window by window; its ids are one row, as the text is.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
                       .alias("text")).mapInArrow(
        partial(_encode, path=path, compressed=pretokens.class_table()),
        "doc_id long, ids array<int>, offsets array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = tokens_of(path)
    for batch in batches:
        ids, offsets = column(batch, "ids"), column(batch, "offsets")
        bounds = np.asarray(ids.offsets).astype(np.int64)
        first, last = int(bounds[0]), int(bounds[-1])
        numbers, places = np.asarray(ids.values)[first:last], np.asarray(offsets.values)
        places = places[offsets.offsets[0].as_py():offsets.offsets[-1].as_py()].astype(np.int64)
        bounds -= first
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(known.sizes)
                             or not known.sizes[numbers].all()):
            raise ValueError("an id is not in the vocabulary")
        ends = places + known.sizes[numbers]
        rows = np.flatnonzero(bounds[1:] > bounds[:-1])
        sizes = np.zeros(len(bounds) - 1, np.int64)
        sizes[rows] = ends[bounds[rows + 1] - 1] - places[bounds[rows]]
        starts = np.cumsum(sizes) - sizes
        shift = np.zeros(len(sizes), np.int64)
        shift[rows] = starts[rows] - places[bounds[rows]]  # a run of tokens begins at 0
        to = places + np.repeat(shift, np.diff(bounds))
        text = np.zeros(int(sizes.sum()), np.uint8)
        for a in range(0, len(numbers), DECODED):
            own, at = numbers[a:a + DECODED], to[a:a + DECODED]
            size = known.sizes[own]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text[np.repeat(at, size) + step] = known.bytes[np.repeat(known.places[own], size) + step]
        cuts = pa.array(np.append(starts, len(text)).astype(np.int32)).buffers()[1]
        decoded = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, cuts, pa.py_buffer(text)])
        yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids`` put at their ``offsets``, to rows of ``encode`` or to
    rows that hold a run of their tokens. An id out of the vocabulary is an error."""
    rows = encoded.select("doc_id", "ids", "offsets")
    return rows.mapInArrow(partial(_decode, path=path),
                           "doc_id long, ids array<int>, offsets array<int>, decoded binary")
