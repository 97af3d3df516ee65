"""Substring dedup with a compressed FM-index for each shard.

A window of WINDOW words is a row of blocks of BLOCK words that stand BLOCK words apart. A shard's segments (see segments.py) are therefore
indexed as one text of blocks: for each segment its blocks at the places 0, BLOCK, 2 BLOCK ..., then those at 1, BLOCK + 1 ..., and so on, each row
ended by a separator of its own. The index has the Burrows-Wheeler transform of that text in a wavelet matrix: packed bits, with
32-bit counts for 512 bits and 16-bit counts for 64 bits. Only the minima of stretches of document numbers are kept sorted for range queries.

Equal segments are in that text once, with the smallest document that has them. All are streamed against it, on behalf of the largest document that has them:
for every window, backward search adds one block to the left at a time, for all windows at once, which gives the matching statistic in blocks up to
the window's length; where it reaches the length, the interval's smallest document is looked up. Windows whose interval holds no smaller document any more drop out on the way: they are no longer than that.

Words are unchanged runs of anything but ASCII white space. A word goes if it is covered by a window of WINDOW words that also starts in a document with a
smaller doc_id. Null and empty texts have no words and keep none. Rows with a null id are never touched. Rows equal in
id and text are one document; repeats between rows of one id do not count. An empty table gives an empty one. Texts of any length are cut into
segments; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.segments import Windows, distinct, removed_repeats

WINDOW, BLOCK = 50, 5
#: Document numbers in a stretch.
STRETCH = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a text whose suffixes all differ, by doubling of the sorted length."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, k = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return order


class WaveletMatrix:
    """Counts of a symbol before a place in a sequence."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        now = sequence
        for b in reversed(range(bits)):
            bit = (now >> b & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 512 + 512)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64).reshape(-1, 8)
            large = np.concatenate([[0], np.cumsum(ones.sum(1))[:-1]]).astype(np.uint32)
            small = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()
            self.levels.append((packed, large, small, len(bit) - int(bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, plus a constant of the symbol."""
        at = place
        for level, (packed, large, small, zeros) in enumerate(self.levels):
            word = at >> 6
            below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = large[at >> 9].astype(np.int64) + small[word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search in rows of symbols, with the smallest document of each interval."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, document: np.ndarray):
        """symbols: numbers from 0 on, row by row. sizes: of the rows. document: of each row."""
        n, m = len(symbols), len(sizes)
        text, stops = np.empty(n + m, np.int64), np.cumsum(sizes + 1) - 1
        inside = np.ones(n + m, bool)
        inside[stops] = False
        text[inside], text[stops] = symbols + m, np.arange(m)
        order = suffix_order(text)
        count = int(symbols.max()) + 1
        self.bits = max(1, int(count).bit_length())
        before = text[order - 1]
        self.matrix = WaveletMatrix(np.where(before < m, count, before - m).astype(np.int32), self.bits)
        self.first = m + np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=count))])
        self.base = self.matrix.rank(np.arange(count), np.zeros(count, np.int64))
        self.documents, owner = np.unique(document, return_inverse=True)
        self.owner = np.append(np.repeat(owner, sizes + 1)[order], np.full(2 * STRETCH, len(self.documents))).astype(np.int32)
        self.least = [self.owner[: len(self.owner) // STRETCH * STRETCH].reshape(-1, STRETCH).min(1)]
        while 2 << (len(self.least) - 1) <= len(self.least[0]):
            last, k = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-k], last[k:]))

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of single symbols."""
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol on the left."""
        both = self.matrix.rank(np.tile(symbol, 2), np.concatenate([low, high])) + np.tile(self.first[symbol] - self.base[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of each non-empty interval."""
        out = np.full(len(low), len(self.documents), np.int32)
        for i in range(STRETCH):  # up to a stretch's border from either end
            for at in (low + i, high - 1 - i):
                np.minimum(out, self.owner[at], out=out, where=(at >= low) & (at < high))
        a, b = -(-low // STRETCH), high // STRETCH
        whole = np.flatnonzero(b > a)
        level = np.frexp((b - a)[whole].astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = whole[level == k]
            out[own] = np.minimum(out[own], np.minimum(self.least[k][a[own]], self.least[k][b[own] - (1 << int(k))]))
        return self.documents[out]


def blocks_of(words: list[list[bytes]], block: int) -> np.ndarray:
    """The number of the block that begins at each place of the joined segments; equal blocks have equal numbers. Those that reach over a segment's end mean nothing."""
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(w, len(numbers)) for own in words for w in own], np.int64)
    out, done = number, 1
    for _ in range(block - 1):
        key = out[: len(number) - done] * len(number) + number[done:]
        out, done = np.unique(key, return_inverse=True)[1], done + 1
    return np.append(out, np.zeros(done - 1, np.int64))


def repeated_windows(contents: list[bytes], documents: list[int], lasts: list[int], times: list[int], length: int = WINDOW, block: int = BLOCK) -> list[list[tuple[int, int, int]]]:
    """Of each segment (first window, after the last, smallest document that has them) for the windows that a smaller document has than the largest with that segment."""
    different, which = distinct(contents)
    document, last = np.full(len(different), np.iinfo(np.int64).max), np.full(len(different), np.iinfo(np.int64).min)
    np.minimum.at(document, which, documents)
    np.maximum.at(last, which, lasts)
    words = [c.split() for c in different]
    size = np.array([len(own) for own in words])
    number, begin = blocks_of(words, block), np.cumsum(size) - size
    # The blocks of each segment by their place modulo the block's length.
    whole = size - block + 1
    owner = np.repeat(np.arange(len(size)), whole)
    place = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
    row = owner * block + place % block
    order = np.lexsort((place, row))
    rows, sizes = np.unique(row, return_counts=True)
    index = FMIndex(number[begin[owner] + place][order], sizes, document[rows // block])
    n = size - length + 1
    segment = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    smallest, active = last[segment], np.arange(len(start))
    for step in range(length // block):
        symbol = number[start[active] + length - block * (step + 1)]
        low, high = index.extend(symbol, low, high) if step else index.start(symbol)
        least = index.smallest(low, high)
        on = least < last[segment[active]]
        active, low, high, least = active[on], low[on], high[on], least[on]
        if not len(active):
            break
    smallest[active] = least
    out, at = [], 0
    for k, top in zip(n.tolist(), last.tolist(), strict=True):
        own = smallest[at : at + k]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out.append([(int(a), int(b), int(own[a])) for a, b in zip(first, np.append(first[1:], k), strict=True) if own[a] < top])
        at += k
    return [out[w] for w in which.tolist()]


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, n_removed, kept_sha256, kept): a row for each row of ``docs``.

    digest: xxhash64 of the text. kept: the words left, joined by one space, as bytes; null where nothing is removed.
    """
    windows = Windows(words=True, length=WINDOW, gram=8, other_documents=True)
    out = removed_repeats(docs, windows, repeated_windows, id_column, text_column)
    return out.select(F.col(id_column), "digest", F.col("n").alias("n_words"), "n_removed", "kept_sha256", "kept")
