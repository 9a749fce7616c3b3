"""Where the pre-tokens of byte-level BPE begin, found over whole arrays and without regex.

The pattern is that of ``public_tokenizers.PATTERN``: contractions, letters, numbers and other
signs, each with one space before it, and white space. Every code point gets a symbol: its class,
and for apostrophes and white space what follows. A small automaton over the symbols says where a
token starts. Its transition functions are closed under composition, and composing them is
associative: with a number for each function and a table of their products, the states before all
code points come from a blocked prefix scan of table look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from lehrplan.llm.arrays import BASE, VALUES, Block, mix, powers

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)  # classes; BLANK: white space but U+0020
WINDOW = 1 << 18
AHEAD = 4  # code points before a window's end whose tokens may still change

# symbols: the class, APOSTROPHE + letters of the contraction to come, or white space that is the
# last before something else
(S_OTHER, S_LETTER, S_NUMBER, S_BLANK, S_SPACE, S_SHORT, S_LONG, S_LAST_BLANK,
 S_LAST_SPACE) = range(9)
SYMBOLS = 9
CLOSED, LETTERS, NUMBERS, OTHERS, OPEN, RUN, ONE, TWO = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, for every state and symbol; symbols from SYMBOLS
    on are those of the first code point of a row."""
    fresh = {S_OTHER: OTHERS, S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_BLANK: RUN, S_SPACE: RUN,
             S_SHORT: ONE, S_LONG: TWO, S_LAST_BLANK: CLOSED, S_LAST_SPACE: OPEN}
    signs = (S_OTHER, S_SHORT, S_LONG)
    goes_on = {(LETTERS, S_LETTER): LETTERS, (NUMBERS, S_NUMBER): NUMBERS,
               (OPEN, S_LETTER): LETTERS, (OPEN, S_NUMBER): NUMBERS,
               (RUN, S_BLANK): RUN, (RUN, S_SPACE): RUN}
    goes_on |= {(state, s): OTHERS for state in (OTHERS, OPEN) for s in signs}
    goes_on |= {(state, s): to for state, to in ((ONE, CLOSED), (TWO, ONE)) for s in range(SYMBOLS)}
    after = np.zeros((STATES, 2 * SYMBOLS), np.uint8)
    starts = np.ones((STATES, 2 * SYMBOLS), bool)
    for state in range(STATES):
        for s in range(SYMBOLS):
            after[state, s] = goes_on.get((state, s), fresh[s])
            starts[state, s] = (state, s) not in goes_on
            after[state, SYMBOLS + s] = fresh[s]
    return after, starts


AFTER, STARTS = _automaton()


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the transition functions, the identity first and then one for each
    symbol, and the table of their products (the left one goes first)."""
    functions = [tuple(range(STATES))]
    number = {functions[0]: 0}
    of_symbol = []
    for s in range(2 * SYMBOLS):
        f = tuple(int(x) for x in AFTER[:, s])
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        of_symbol.append(number[f])
    done = 0
    while done < len(functions):
        for s in range(2 * SYMBOLS):
            f = tuple(int(AFTER[state, s]) for state in functions[done])
            if f not in number:
                number[f] = len(functions)
                functions.append(f)
        done += 1
    table = np.array(functions, np.uint8)
    places = 8 ** np.arange(STATES)
    codes = table @ places
    order = np.argsort(codes)
    product = order[np.searchsorted(codes[order], table[:, table].transpose(1, 0, 2) @ places)]
    return np.array(of_symbol, np.uint16), table, product.astype(np.uint16)


OF_SYMBOL, FUNCTIONS, PRODUCT = _closure()


SCALED = (PRODUCT.astype(np.int32) * len(FUNCTIONS)).ravel()  # products times their number: row offsets


def scan(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix products: rows of ``width`` side by side, then their totals in the same
    way, then every row behind the product of the rows before it."""
    count, k = len(functions), len(FUNCTIONS)
    if count <= 1:
        return functions.astype(np.int32)
    rows = -(-count // width)
    padded = np.zeros(rows * width, np.int32)  # 0 is the identity
    padded[:count] = functions
    own = np.ascontiguousarray(padded.reshape(rows, width).T)
    grid = np.empty_like(own)  # products times k
    grid[0] = own[0] * k
    for t in range(1, width):
        np.take(SCALED, grid[t - 1] + own[t], out=grid[t])
    if rows > 1:
        before = np.zeros(rows, np.int32)
        before[1:] = scan(grid[-1] // k, width)[:-1]
        grid = SCALED[before * k + grid // k]
    return grid.T.ravel()[:count] // k


@lru_cache(1)
def class_table() -> bytes:
    """Class of every code point, compressed, in the version of Unicode of the tiktoken library."""
    import tiktoken
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    bytes_only = {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        known = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        found = known.decode_bytes(known.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    table[32] = SPACE
    return zlib.compress(table.tobytes())


@lru_cache(2)
def classes(compressed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(compressed), np.uint8)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and number of every code point of UTF-8 ``data``."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[places].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        padded = np.zeros(len(data) + 3, np.uint8)
        padded[:len(data)] = data
        at, lead = places[wide], points[wide]
        one, two, three = ((padded[at + i] & 0x3F).astype(np.int32) for i in (1, 2, 3))
        short = (lead & 0x1F) << 6 | one
        middle = (lead & 0x0F) << 12 | one << 6 | two
        long = (lead & 0x07) << 18 | one << 12 | two << 6 | three
        points[wide] = np.where(lead < 0xE0, short, np.where(lead < 0xF0, middle, long))
    return places, np.minimum(points, 0x10FFFF)


def token_starts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and where code points do; rows begin at ``offsets``."""
    places, points = code_points(data)
    if not len(places):
        return places, places
    kind = table[points]
    heads = np.searchsorted(places, offsets[:-1][offsets[1:] > offsets[:-1]])
    first = np.zeros(len(places) + 2, bool)
    first[heads] = True
    first[len(places):] = True
    symbol = kind.copy()
    # white space: is the next code point of the row something else?
    after = np.full(len(places), S_BLANK, np.uint8)
    after[:-1] = kind[1:]
    last = ~first[1:len(places) + 1] & (after < BLANK)
    symbol[(kind == BLANK) & last] = S_LAST_BLANK
    symbol[(kind == SPACE) & last] = S_LAST_SPACE
    # apostrophes: do the letters of a contraction follow in the row?
    marks = np.flatnonzero(points == 39)
    if len(marks):
        padded = np.zeros(len(points) + 2, np.int32)
        padded[:len(points)] = points
        one = np.where(first[marks + 1], 0, padded[marks + 1])
        two = np.where(first[marks + 1] | first[np.minimum(marks + 2, len(places))], 0,
                       padded[marks + 2])
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = one << 8 | two
        symbol[marks[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = S_LONG
    symbol[heads] += SYMBOLS
    states = FUNCTIONS[:, CLOSED][scan(OF_SYMBOL[symbol])]
    start = np.ones(len(places), bool)
    start[1:] = STARTS.ravel()[states[:-1] * np.int16(2 * SYMBOLS) + symbol[1:]]
    return places[start], places


def tokens(block: Block, table: np.ndarray, window: int = WINDOW,
           ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of a block: bytes, and start and end of every pre-token in them, in order.

    The windows are the block's bytes one after the other, so a long row passes in bounded
    memory. Tokens at the end of a window, which what follows may change, go to the next one; a
    token longer than a window makes that one longer.
    """
    size, at, width = len(block.data), 0, window
    while at < size:
        end = min(size, at + width)
        while end < size and block.data[end] & 0xC0 == 0x80:
            end += 1
        data = block.data[at:end]
        bounds = block.offsets[(block.offsets > at) & (block.offsets < end)] - at
        starts, places = token_starts(data, np.concatenate([[0], bounds, [end - at]]), table)
        stop = end - at
        if end < size:
            sure = starts[starts <= places[max(0, len(places) - AHEAD)]]
            if len(sure) < 2:
                width *= 2
                continue
            starts, stop = sure[:-1], int(sure[-1])
        width = window
        yield data[:stop], starts, np.append(starts[1:], stop)
        at += stop


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans."""
    sums = Block(0, data, np.array([0, len(data)])).prefix(VALUES[data])
    found = (sums[ends] - sums[starts]) * powers(BASE, len(data) + 1)[starts]
    return mix(found ^ (ends - starts).astype(np.uint64))
