"""Text columns as byte arrays inside Arrow passes.

A block is a run of rows whose UTF-8 bytes lie one after the other in one array of bounded
size (one row, where that row alone is larger), so a pass needs memory for one block and not
for a whole partition. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

pa.set_memory_pool(pa.system_memory_pool())  # idle workers give freed batches back

# words of decontamination and near-duplicates: 0-9, a-z (after lower-casing A-Z), all above ASCII
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True

# polynomial hashes modulo 2**64 over random byte values; an odd base has an inverse
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0 ... base**(count - 1); kept for blocks of the usual size only."""
    known = _powers.get(int(base))
    if known is None or len(known) < count:
        table = np.full(max(count, BLOCK_BYTES + 4096), base, np.uint64)
        table[0] = 1
        known = np.cumprod(table)
        if count <= 4 * BLOCK_BYTES:
            _powers[int(base)] = known
    return known[:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Rows ``first`` ... of a batch: ``data`` holds their bytes, ``offsets`` their bounds."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums over all prefixes of values[i] * INVERSE**i."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(INVERSE, len(values)), out=sums[1:])
        return sums

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, row (inside the block) and 64-bit hash of every word, in order."""
        inside = IN_WORD[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(self.offsets, starts, side="right") - 1
        sums = self.prefix(VALUES[LOWER[self.data]])
        hashes = (sums[ends] - sums[starts]) * powers(BASE, len(inside) + 1)[starts]
        return starts, ends, row, mix(hashes ^ (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows, without a copy if none is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, kind)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else \
        np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, most: int = 4096) -> Iterator[Block]:
    """Cut a string column into blocks of at most ``limit`` bytes, or of one row, and at most
    ``most`` rows."""
    data, offsets = utf8(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows, first + most)
        yield Block(first, data[offsets[first]:offsets[last]],
                    offsets[first:last + 1] - offsets[first])
        first = last


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as little-endian numbers; zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return view64(padded)


def view64(padded: np.ndarray) -> np.ndarray:
    """The same of bytes that end with eight spare ones, without a copy."""
    return np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))


MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def same_bytes(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray,
               lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` in ``one`` and from ``b`` in ``two`` (both as ``words64``
    gives them) are equal over ``lengths``."""
    same = (one[a] ^ two[b]) & MASKS[np.minimum(lengths, 8)] == 0
    left, done = np.flatnonzero(same & (lengths > 8)), 8
    while len(left):
        if done >= 256:  # few and long: compare each at once
            for i in left:
                x, y, n = int(a[i]), int(b[i]), int(lengths[i])
                same[i] = np.array_equal(one[x:x + n - 7:8], two[y:y + n - 7:8]) and \
                    one[x + n - 8] == two[y + n - 8]
            break
        size = np.minimum(lengths[left] - done, 8)
        differ = (one[a[left] + done] ^ two[b[left] + done]) & MASKS[size] != 0
        same[left[differ]] = False
        left = left[~differ & (lengths[left] > done + 8)]
        done += 8
    return same


def first_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray,
                keys: np.ndarray | None = None) -> np.ndarray:
    """For every span the index of one span with the same bytes (and key), the same for all.

    An open hash table holds one span a slot. All spans probe in step: those that meet an empty
    slot write to it, those that meet a span equal in length, key and bytes are done, the others
    go on to the next slot. Hashes place spans and never decide; bytes do.
    """
    count = len(starts)
    owner = np.full(count, -1, np.int64)
    if not count:
        return owner
    size = 1 << max(4, (2 * count - 1).bit_length())
    table = np.full(size, -1, np.int64)
    slot = (hashes & np.uint64(size - 1)).astype(np.int64)
    lengths, eight = ends - starts, words64(data)
    left = np.arange(count)
    while len(left):
        at = slot[left]
        free = table[at] < 0
        table[at[free]] = left[free]
        met = table[at]
        same = (lengths[met] == lengths[left]) & (hashes[met] == hashes[left])
        if keys is not None:
            same &= keys[met] == keys[left]
        sure = np.flatnonzero(same)
        same[sure] = same_bytes(eight, starts[met[sure]], eight, starts[left[sure]],
                                lengths[left[sure]])
        owner[left[same]] = met[same]
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return owner
