"""Alignment of sentences of two versions of a text by their lengths (Gale and Church, 1993).

Chunks that are linked, such as paragraphs or whole texts, are aligned each by itself, so a task holds two chunks. A bead is a pair of none to two
sentences on either side; how probable it is follows from its kind and from how the lengths differ. Where one text is the other with
some sentences joined, the beads are read off in one pass, since no others can be cheaper. Else all cells with one sum of places are
worked out at once, in a band: the cells that the cost of a first path leaves or, where it leaves many, those around the line along which
both texts advance alike.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How probable beads are, by sentences on the left and on the right, and the mean and variance of right characters for a left one, as published.
BEADS = {(1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099, (2, 1): 0.089, (1, 2): 0.089, (2, 2): 0.011}
MEAN, VARIANCE = 1.0, 6.8


def bead_costs(left: np.ndarray, right: np.ndarray, prior: float) -> np.ndarray:
    """Negative logarithms of the chances of beads with so many characters on either side."""
    deviation = np.abs(right - left * MEAN) / np.sqrt(np.maximum((left + right / MEAN) / 2, 1.0) * VARIANCE)
    # The tail of the normal distribution by a rational approximation (Abramowitz and Stegun, 26.2.17).
    t = 1 / (1 + 0.2316419 * deviation)
    tail = np.exp(-deviation * deviation / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return -np.log(np.maximum(2 * tail, 1e-300)) - np.log(prior)


COSTS = {kind: -math.log(p) for kind, p in BEADS.items()}
#: What a sentence on the left and one on the right cost at least: a bead of any kind costs as much as its sentences, or more (a table of its multipliers, as in linear programming).
LEAST = (
    (COSTS[2, 1] - COSTS[1, 1], 2 * COSTS[1, 1] - COSTS[2, 1]), (2 * COSTS[1, 1] - COSTS[1, 2], COSTS[1, 2] - COSTS[1, 1]),
    (COSTS[1, 0], COSTS[2, 1] - 2 * COSTS[1, 0]), (COSTS[1, 2] - 2 * COSTS[0, 1], COSTS[0, 1]),
)


def _read_off(first: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bead of each sentence in its chunk, whether they hold for each chunk): they do if one text is the other with some pairs of sentences joined.

    Then no lengths differ and the kinds cost what LEAST asks for so many sentences. Other beads would end where both texts have come equally far, too; with no empty sentences, those are the same ones.
    Many chunks at once, each with its left sentences before its right ones. first: where a chunk begins.
    """
    edges, chunk, bead = np.flatnonzero(first), np.cumsum(first) - 1, np.zeros(len(lengths), np.int64)
    far = np.where(right, lengths, lengths * MEAN)
    read = (np.add.reduceat(np.where(right, far, -far), edges) == 0) & (np.minimum.reduceat(lengths, edges) > 0)
    rows = [np.flatnonzero(read[chunk] & side) for side in (~right, right)]
    ways = [np.cumsum(far[own]) for own in rows]  # both texts of every chunk come equally far, so chunks need no ways of their own
    sizes, of = [], np.zeros(0, np.int64)
    for own, way, other in zip(rows, ways, ways[::-1], strict=True):
        ends = other[np.searchsorted(other, way)] == way if len(way) else np.zeros(0, bool)
        bead[own] = np.cumsum(ends) - ends
        sizes.append(np.bincount(bead[own]))
        of = chunk[own][ends]
    x, y = sizes
    joined = np.zeros((2, len(edges)), bool)
    joined[0, of[x > 1]] = joined[1, of[y > 1]] = True
    begin = np.searchsorted(of, np.arange(len(edges)))
    read[of[x + y > 3]] = False
    return bead - np.where(read, begin, 0)[chunk], read & ~joined.all(0)


def _joined(left: list[int], right: list[int]) -> list[tuple[int, int, int, int]] | None:
    """The beads, if one text is the other with some pairs of sentences joined, else None."""
    if not left or not right:
        return None if left or right else []
    n, lengths = len(left), np.array([*left, *right])
    at = np.arange(len(lengths))
    bead, read = _read_off(at == 0, at >= n, lengths)
    if not read[0]:
        return None
    i, j = ([*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)] for own in (bead[:n], bead[n:]))
    return list(zip(i, i[1:], j, j[1:], strict=False))


def _around(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place on the left for every sum of places: those at most ``width`` sentences off the line along which both texts advance alike, or all."""
    n, m = len(a) - 1, len(b) - 1
    total = np.arange(n + m + 1)
    low, high = np.maximum(0, total - m), np.minimum(n, total)
    if width > n + m:
        return low, high
    # The place on the left that the line has when left and right places sum to a total: both texts have come equally far, counted in characters and sentences.
    left = (a + 1e-9 * np.arange(n + 1)) / max(a[-1] + 1e-9 * n, 1e-12)
    right = (b + 1e-9 * np.arange(m + 1)) / max(b[-1] + 1e-9 * m, 1e-12)
    on_line = np.searchsorted(right, left).clip(0, m) + np.arange(n + 1)
    middle = np.searchsorted(on_line, total).clip(0, n)
    middle[0], middle[-1] = 0, n
    return np.maximum(low, np.minimum(middle - width, high)), np.minimum(high, np.maximum(middle + width, low))


def _within(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray] | None:
    """As _around(), all cells through which a path of at most this cost can go; None if nothing is known.

    A bead whose lengths differ by d and sum to s costs d * d / (VARIANCE * s) besides its kind, or more; so a path on which they differ by D in all costs D * D / (VARIANCE * S) at least, and D is no less
    than how far one text is ahead at a cell plus what changes from there to the end.
    """
    n, m = len(a) - 1, len(b) - 1
    spare = cost - max(u * n + v * m for u, v in LEAST) + 1e-6 * (n + m)
    if not spare < 600:  # the chances in bead_costs() have a least value
        return None
    reach, ahead = math.sqrt(max(spare, 0.0) * VARIANCE * (a[-1] + b[-1] / MEAN + 2 * (n + m))) + 1e-6, a[-1] * MEAN - b[-1]
    total = np.arange(n + m + 1)

    def first(least: float, after: bool) -> np.ndarray:
        """The first place on the left at which the left text is so far ahead, or farther, by bisection for all sums at once."""
        low, high = np.maximum(0, total - m), np.minimum(n, total) + 1
        while (open_ := low < high).any():
            at = np.where(open_, (low + high) // 2, np.minimum(low, np.minimum(n, total)))
            x = a[at] * MEAN - b[total - at]
            there = x > least if after else x >= least
            low, high = np.where(open_ & ~there, at + 1, low), np.where(open_ & there, at, high)
        return low

    return first((ahead - reach) / 2, False), first((ahead + reach) / 2, True) - 1


#: Cells whose costs are worked out at a time.
CELLS = 1 << 16


def _banded(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[tuple[int, int, int, int]], float, bool]:
    """(beads, their cost, whether they touch the band's edge) among the cells from first to last of every sum of places. a, b: running lengths from 0."""
    n, m = len(a) - 1, len(b) - 1
    kinds, sizes = list(BEADS), np.maximum(last - first + 1, 0)
    ends, lows = np.cumsum(sizes), first.tolist()
    rows: dict[int, np.ndarray] = {0: np.zeros(1)}
    moves: list[np.ndarray] = [np.zeros(1, np.int8)]
    begin = 1
    while begin <= n + m:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin - 1] + CELLS, "right")))
        own = sizes[begin:end]
        start = np.cumsum(own) - own
        i = np.repeat(first[begin:end] - start, own) + np.arange(own.sum())
        j = np.repeat(np.arange(begin, end), own) - i
        costs = []
        for x, y in kinds:  # places before the first are never taken
            i0, j0 = np.maximum(i - x, 0), np.maximum(j - y, 0)
            costs.append(bead_costs(a[i] - a[i0], b[j] - b[j0], BEADS[x, y]))
        for total, at, size in zip(range(begin, end), start.tolist(), own.tolist(), strict=True):
            low, cost, move = lows[total], np.full(size, np.inf), np.zeros(size, np.int8)
            for k, (x, y) in enumerate(kinds):
                before = rows.get(total - x - y)
                if before is None:
                    continue
                shift = lows[total - x - y] + x
                s, e = max(low, shift), min(low + size, shift + len(before))
                if s < e:
                    new, old = before[s - shift : e - shift] + costs[k][at + s - low : at + e - low], cost[s - low : e - low]
                    better = new < old
                    np.copyto(old, new, where=better)
                    np.putmask(move[s - low : e - low], better, k)
            rows[total] = cost
            rows.pop(total - 4, None)
            moves.append(move)
        begin = end
    out, i, j, edge = [], n, m, False
    if not np.isfinite(rows[n + m]).all():
        return out, math.inf, True
    while i or j:
        low, move = lows[i + j], moves[i + j]
        edge |= i == low and i > max(0, i + j - m) or i == low + len(move) - 1 and i < min(n, i + j)
        x, y = kinds[move[i - low]]
        out.append((i - x, i, j - y, j))
        i, j = i - x, j - y
    return out[::-1], float(rows[n + m][-1]), edge


def _small(left: list[int], right: list[int]) -> list[tuple[int, int, int, int]]:
    """The cheapest beads of a few sentences, a cell at a time: arrays would cost more than they save."""
    n, m = len(left), len(right)
    a, b = [0, *itertools.accumulate(left)], [0, *itertools.accumulate(right)]
    priors = [(x, y, prior) for (x, y), prior in COSTS.items()]
    cost, move = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            for x, y, prior in priors:
                if i >= x and j >= y:
                    new = cost[i - x, j - y] + _length_cost(a[i] - a[i - x], b[j] - b[j - y]) + prior
                    if new < cost.get((i, j), math.inf):
                        cost[i, j], move[i, j] = new, (x, y)
    out, i, j = [], n, m
    while i or j:
        x, y = move[i, j]
        out.append((i - x, i, j - y, j))
        i, j = i - x, j - y
    return out[::-1]


@functools.lru_cache(1 << 16)
def _length_cost(left: int, right: int) -> float:
    return float(bead_costs(np.array([float(left)]), np.array([float(right)]), 1.0)[0])


#: Sentences on either side of the line that are looked at first, those for a first path, and cells that are worked out one by one.
WIDTH, NARROW, FEW = 64, 8, 1024


def aligned_lengths(left: list[int], right: list[int], width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """The cheapest beads as (first left, after the last left, first right, after the last right).

    A path in a narrow band tells which cells a cheaper one can go through. If they are no more than two bands of the width have, they are worked out, and the beads are proven to be the cheapest. Else only cells
    near the line along which both texts advance alike are, so memory grows with the number of sentences: the band is doubled until the beads don't touch its edge and a band twice as
    wide costs as much, or it is the whole.
    """
    return _joined(left, right) or _cheapest(left, right, width)


def _cheapest(left: list[int], right: list[int], width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """As aligned_lengths(), from costs of cells."""
    if (len(left) + 1) * (len(right) + 1) <= FEW:
        return _small(left, right)
    a, b = np.concatenate([[0], np.cumsum(left)]).astype(float), np.concatenate([[0], np.cumsum(right)]).astype(float)
    n_all = len(left) + len(right)
    if n_all > 4 * width:
        band = _around(a, b, NARROW)
        found, cost, _ = _banded(a, b, *band)
        cells = _within(a, b, cost)
        if cells and (cells[0] >= band[0]).all() and (cells[1] <= band[1]).all():
            return found
        if cells and np.maximum(cells[1] - cells[0] + 1, 0).sum() <= 6 * width * n_all:
            return _banded(a, b, *cells)[0]
    else:
        width = n_all + 1
    while True:
        found, cost, edge = _banded(a, b, *_around(a, b, width))
        if width > n_all:
            return found
        if not edge:
            again, wider, _ = _banded(a, b, *_around(a, b, 2 * width))
            if wider >= cost - 1e-9:
                return found
        width *= 2


def _beads(first: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bead of each sentence in its chunk, as for _read_off()."""
    bead, read = _read_off(first, right, lengths)
    edges = [*np.flatnonzero(first).tolist(), len(first)]
    for k in np.flatnonzero(~read).tolist():
        begin, end = edges[k], edges[k + 1]
        middle = end - int(right[begin:end].sum())
        found = np.array(_cheapest(lengths[begin:middle].tolist(), lengths[middle:end].tolist())).reshape(-1, 4)
        for at, sizes in ((begin, found[:, 1] - found[:, 0]), (middle, found[:, 3] - found[:, 2])):
            bead[at : at + sizes.sum()] = np.repeat(np.arange(len(found)), sizes)
    return bead


#: Rows that are aligned and given on at a time, or those of one chunk if it has more.
ROWS = 1 << 16


def align(left: DataFrame, right: DataFrame, key: str = "link", dealt: bool = False) -> DataFrame:
    """(key, bead, side, idx): of every linked chunk its beads, numbered, with the sentences of both sides; nulls and sentences of one side only are beads of their own.

    left, right: key, idx, length; idx gives the order of the sentences in the chunk. dealt: both sides are repartitioned by the key already, into the same number of partitions, so that neither is shuffled again.
    """
    kind, name = dict(left.dtypes)[key], pa.array(["left", "right"])
    n_tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be put into fewer tasks
    sides = []
    for t, side in ((left, False), (right, True)):
        own = t if dealt else t.repartition(n_tasks, key)
        sides.append(own.select(F.col(key), F.lit(side).alias("is_right"), F.col("idx").cast("long").alias("idx"), F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long").alias("length")))
    # A row for each chunk: Spark looks at the size of what it hands to Python after every row.
    both = sides[0].union(sides[1]).groupBy(key).agg(F.collect_list(F.struct("is_right", "idx", "length")).alias("rows"))

    def beads(part: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        flat, chunk = part.column("rows").flatten(), np.repeat(np.arange(len(sizes)), sizes)
        idx, own = pc.struct_field(flat, "idx"), [pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("length", "is_right")]
        order = np.lexsort((own[0], pc.fill_null(idx, np.iinfo(np.int64).min).to_numpy(), own[1], chunk))
        lengths, right = (x[order] for x in own)
        found = _beads(np.diff(chunk, prepend=-1) > 0, right, lengths)
        return pa.RecordBatch.from_arrays([part.column(key).take(pa.array(chunk)), pa.array(found.astype(np.int32)), name.take(pa.array(right.astype(np.int8))), idx.take(pa.array(order))], [key, "bead", "side", "idx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("rows")).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
                yield beads(batch.slice(at, end - at), sizes[at:end])
                at = end

    return both.mapInArrow(run, f"{key} {kind}, bead int, side string, idx long")
