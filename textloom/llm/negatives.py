"""Hard negatives by a vector-approximation file.

Vectors are packed into blocks. A block quantises each dimension into 16 cells that hold as many of its vectors each, and keeps the smallest and the
largest value of every cell; a vector is its cells, two dimensions a byte. For an anchor the products with these values give a table a byte, and two sums of table entries
bound a vector's inner product from both sides. Only vectors whose bounds let them enter the anchor's windows are scored exactly.

An anchor's positives are its ``n_positives`` best other rows of its label. Its negatives for a positive are the ``n_negatives`` best rows of other labels whose score is at least ``low``
and at most ``high`` hundredths of the positive's. Higher scores come first, ties by smaller id.

The anchors are a stated query set: they are taken in passes of some ANCHORS_A_PASS, broadcast, against all blocks, which stay where they are. Each task keeps its best rows
for an anchor, and a ranking merges the tasks' rows. The work grows with anchors times rows.

Rows with a null id or label, a null vector or a null or non-finite component take no part. Components become floor(scale * x). Only vectors of one length are compared. Rows with the anchor's own id are neither its
positives nor its negatives; of anchor rows with one id the smallest (label, vector) counts; other repeated rows are rows of their own. Scores are exact; those beyond 64 bits are given as the
nearest number of 64 bits. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

CELLS = 16
ROWS_A_BLOCK, BYTES_A_BLOCK = 4096, 4 << 20
ANCHORS_A_PASS = 2048
#: Anchors whose bounds are summed together.
TOGETHER = 32
SCALE = 256
BLOCK = "dimension int, n int, ids binary, labels binary, vectors binary, cells binary, least binary, most binary"


def packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """One block of the file: rows sorted by label, their cells, and each cell's bounds by dimension."""
    order = np.lexsort((ids, labels))
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    n, dimension = vectors.shape
    edges = np.quantile(vectors, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if dimension else np.zeros((CELLS - 1, 0))
    cells = np.zeros((n, dimension), np.uint8)
    for edge in edges:
        cells += vectors > edge
    least, most = np.zeros((CELLS, dimension)), np.zeros((CELLS, dimension))
    for c in range(CELLS):
        inside = cells == c
        there = inside.any(0)
        least[c] = np.where(there, np.where(inside, vectors, np.inf).min(0), 0)
        most[c] = np.where(there, np.where(inside, vectors, -np.inf).max(0), 0)
    if dimension % 2:
        cells, least, most = (np.hstack([x, np.zeros((len(x), 1), x.dtype)]) for x in (cells, least, most))
    return {"dimension": dimension, "n": n} | {k: v.tobytes() for k, v in (("ids", ids), ("labels", labels), ("vectors", vectors), ("cells", cells[:, ::2] | cells[:, 1::2] << 4), ("least", least), ("most", most))}


class Block:
    def __init__(self, row: dict):
        self.dimension, n = row["dimension"], row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, self.dimension)
        pairs = (self.dimension + 1) // 2
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(n, pairs)
        self.least, self.most = (np.frombuffer(row[k]).reshape(CELLS, 2 * pairs) for k in ("least", "most"))
        self.largest = np.abs(self.vectors).max(initial=0)

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of inner products, a row an own row and a column an anchor."""
        n_anchors, cells = len(anchors), self.cells[rows]
        if 2 * self.cells.shape[1] > self.dimension:
            anchors = np.hstack([anchors, np.zeros((n_anchors, 1))])
        one, other = self.least[:, :, None] * anchors.T, self.most[:, :, None] * anchors.T  # cell, dimension, anchor
        byte = np.arange(256)
        low, high = np.zeros((len(cells), n_anchors)), np.zeros((len(cells), n_anchors))
        for table, total in ((np.minimum(one, other), low), (np.maximum(one, other), high)):
            for p in range(cells.shape[1]):
                total += (table[byte % CELLS, 2 * p] + table[byte // CELLS, 2 * p + 1])[cells[:, p]]
        # Beyond 53 bits the sums are rounded.
        slack = 0.0 if self.largest * np.abs(anchors).max(initial=0) * max(1, self.dimension) < 2**52 else 1e-9
        if slack:
            slack *= max(1, self.dimension) * self.largest * np.abs(anchors).max(axis=1, initial=0)
        return low - slack, high + slack

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: int64, or Python integers where these may pass 64 bits."""
        bits = float(self.largest) * float(np.abs(anchor).max(initial=0)) * max(1, self.dimension)
        if bits < 2**53:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        kind = np.int64 if bits < 2**62 else object
        exact = lambda x: x.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
        return (exact(self.vectors[rows]) * exact(anchor[None])).sum(1)


class Best:
    """The k best (score, id) so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            if scores.dtype != object and len(scores) > self.k:
                best = np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[best], ids[best]
            self.rows = sorted([*self.rows, *zip(scores.tolist(), ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[: self.k]


def vector_file(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The blocks of (id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)

        def take(dimension: int, least: int) -> Iterator[pa.RecordBatch]:
            size = max(1, min(ROWS_A_BLOCK, BYTES_A_BLOCK // (8 * max(1, dimension))))
            if sum(len(x[0]) for x in held[dimension]) < max(1, min(size, least)):
                return
            whole = [np.concatenate(x) for x in zip(*held[dimension], strict=True)]
            for start in range(0, len(whole[0]), size):
                if start + size > len(whole[0]) and least > 1:
                    held[dimension] = [tuple(x[start:] for x in whole)]
                    return
                yield pa.RecordBatch.from_pylist([packed(*[x[start : start + size] for x in whole])], schema=pa.schema([("dimension", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("ids", "labels", "vectors", "cells", "least", "most")]))
            held[dimension] = []

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column, offsets = part.column("vector"), part.column("vector").offsets.to_numpy()
                ids, labels, sizes = part.column("id").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False), np.diff(offsets)
                values = np.floor(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)  # nulls become nan
                for dimension in np.unique(sizes).tolist():
                    row = np.flatnonzero(sizes == dimension)
                    own = values[offsets[row][:, None] + np.arange(dimension)]
                    good = np.isfinite(own).all(1)
                    held[dimension].append((ids[row][good].astype(np.int64), labels[row][good].astype(np.int64), own[good]))
                    yield from take(dimension, ROWS_A_BLOCK)
        for dimension in list(held):
            yield from take(dimension, 1)

    return vectors.where("id is not null and label is not null and vector is not null").mapInArrow(run, BLOCK)


def _merged(file: DataFrame, visit: Callable[[Block], None], results: Callable[[], list[tuple]]) -> DataFrame:
    """(anchor, n, id, score) that ``results`` has after ``visit`` saw all blocks of a task."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                visit(Block(batch.slice(i, 1).to_pylist()[0]))
        rows = [(a, n, i, min(max(s, -(2**63)), 2**63 - 1)) for a, n, i, s in results()]
        for start in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 10_000], strict=True), schema, strict=True)], schema=schema)

    return file.mapInArrow(run, "anchor long, n int, id long, score long")


def _by_dimension(anchors: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dimension: (ids, labels, vectors)."""
    groups: dict[int, list] = defaultdict(list)
    for a in anchors:
        groups[len(a[2])].append(a)
    return {d: (np.array([a[0] for a in own], np.int64), np.array([a[1] for a in own], np.int64), np.array([a[2] for a in own], np.float64).reshape(len(own), d)) for d, own in groups.items()}


def positives(file: DataFrame, anchors: list[tuple], k: int) -> DataFrame:
    """(anchor, n, id, score) with the k best other rows of an anchor's label in each task."""
    asked = file.sparkSession.sparkContext.broadcast(_by_dimension(anchors))
    best: dict[int, Best] = defaultdict(lambda: Best(k))

    def visit(block: Block) -> None:
        ids, labels, vectors = asked.value.get(block.dimension, (np.zeros(0),) * 3)
        for label in np.intersect1d(labels, block.labels):
            rows = slice(*np.searchsorted(block.labels, [label, label + 1]))
            mine = np.flatnonzero(labels == label)
            for start in range(0, len(mine), TOGETHER):
                some = mine[start : start + TOGETHER]
                low, high = block.bounds(vectors[some], rows)
                for j, anchor in enumerate(some):
                    own = block.ids[rows] != ids[anchor]
                    sure = np.sort(low[own, j])[-k:]
                    least = max(best[ids[anchor]].least(), sure[0] if len(sure) == k else -np.inf)
                    maybe = np.flatnonzero(own & (high[:, j] >= least)) + rows.start
                    best[ids[anchor]].add(block.scores(maybe, vectors[anchor]), block.ids[maybe])

    return _merged(file, visit, lambda: [(int(a), 0, i, s) for a, b in best.items() for s, i in b.rows])


def windows(file: DataFrame, anchors: list[tuple], found: dict[int, list[tuple]], k: int, low_share: int, high_share: int) -> DataFrame:
    """(anchor, n, id, score): in each task the k best rows of other labels in the window of an anchor's n-th positive. found: anchor: [(n, score)]."""
    asked = file.sparkSession.sparkContext.broadcast((_by_dimension([a for a in anchors if a[0] in found]), found))
    best: dict[tuple, Best] = defaultdict(lambda: Best(k))

    def visit(block: Block) -> None:
        groups, goals = asked.value
        ids, labels, vectors = groups.get(block.dimension, (np.zeros(0),) * 3)
        everything = slice(0, len(block.ids))
        for start in range(0, len(ids), TOGETHER):
            low, high = block.bounds(vectors[start : start + TOGETHER], everything)
            for j in range(low.shape[1]):
                anchor, label, vector = int(ids[start + j]), labels[start + j], vectors[start + j]
                other = (block.labels != label) & (block.ids != anchor)
                at_least, at_most = 100 * low[:, j], 100 * high[:, j]
                need = np.zeros(len(other), bool)
                for n, score in goals[anchor]:
                    bottom, top = low_share * score, high_share * score
                    sure = np.sort(low[other & (at_least >= bottom) & (at_most <= top), j])[-k:]
                    least = max(best[anchor, n].least(), sure[0] if len(sure) == k else -np.inf)
                    need |= (at_most >= bottom) & (high[:, j] >= least) & (at_least <= top)
                rows = np.flatnonzero(need & other)
                scores = block.scores(rows, vector)
                whole = scores.astype(object) if scores.dtype == object or np.abs(scores).max(initial=0) > 2**55 else scores
                for n, score in goals[anchor]:
                    inside = (whole * 100 >= low_share * score) & (whole * 100 <= high_share * score)
                    inside = inside.astype(bool)
                    best[anchor, n].add(scores[inside], block.ids[rows[inside]])

    return _merged(file, visit, lambda: [(a, n, i, s) for (a, n), b in best.items() for s, i in b.rows])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "n").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    file = written(vector_file(own.select("id", "label", "vector"), scale), "vector-file")
    usable = own.where("asks and id is not null and label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    anchors = written(usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector"), "anchors")
    n_passes = -(-anchors.count() // ANCHORS_A_PASS)
    out = []
    for number in range(n_passes):
        mine = anchors.where(F.pmod(F.xxhash64("id"), F.lit(n_passes)) == number)
        asked = [(r["id"], r["label"], np.floor(np.array(r["vector"], np.float64) * scale)) for r in mine.collect()]  # some ANCHORS_A_PASS
        best = _ranked(positives(file, asked, n_positives), n_positives).withColumn("n", F.col("place"))
        best = written(best.select("anchor", "n", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
        found: dict[int, list] = defaultdict(list)
        for r in best.collect():  # n_positives an anchor
            found[r["anchor"]].append((r["n"], r["positive_score"]))
        rows = _ranked(windows(file, asked, dict(found), n_negatives, low, high), n_negatives).join(best, ["anchor", "n"])
        rows = rows.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(written(rows, "hard-negatives") if n_passes > 1 else rows)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
