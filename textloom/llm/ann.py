"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

A vector v is scaled to length 1, padded with zeros to ``bits`` dimensions and rotated at
random; its code has the signs of the rotated components, packed. The code stands for
the unit vector s / sqrt(bits) of those signs. With a the inner product of that vector and the rotated
one, <code, q> / a estimates <v / |v|, q> without bias, off by more than
EPSILON * |q| * sqrt((1 - a^2) / a^2 / (bits - 1)) only rarely. A query's rotated components are
rounded to four bits, so that <code, q> is a weighted sum of popcounts of packed words.

Vectors are packed into blocks that stay where they are. The queries are a stated set: they are taken in passes of some QUERIES_A_PASS, broadcast, against all blocks. A task keeps each query's k best of the blocks it has
seen; of the next block it computes exactly every vector whose error bound still reaches the k-th best of those. The tasks' best are merged by a ranking window,
of which Spark keeps only k rows a query and task before the shuffle. The work grows with queries times rows.

All vectors are indexed; nothing is fitted. Left out are vectors that are null, empty or zero, hold a null or
non-finite component, or differ in length from most, and rows with a null id. Of query rows with equal ids the smallest vector
counts; rows with the query's own id are no candidates for it. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

BITS = 256
EPSILON = 2.5
QUERY_BITS = 4
VECTORS_A_BLOCK, QUERIES_A_PASS = 4096, 4096
#: Queries whose estimates are worked out together.
TOGETHER = 32
BLOCK_SCHEMA = "n int, ids binary, vectors binary, codes binary, norms binary, fit binary"


def rotation(dimension: int, bits: int, seed: int = 42) -> np.ndarray:
    """``dimension`` orthonormal columns of length ``bits``."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimension)))[0]


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; the squares of tiny or huge components must not vanish or overflow."""
    largest = np.abs(vectors).max(axis=1)
    largest = np.where(largest > 0, largest, 1.0)
    return largest * np.sqrt(((vectors / largest[:, None]) ** 2).sum(1))


def one_bit_codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed words, lengths, correction scalars a)."""
    norms = lengths(vectors)
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    turned = unit / np.sqrt((unit**2).sum(1))[:, None] @ turn.T
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, norms, np.abs(turned).sum(1) / np.sqrt(turn.shape[0])


def _usable(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as rows) of the rows that take part."""
    column = batch.column("vector")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ids, size = batch.column("id").to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    there = ~np.array(column.is_null()) & (size == dimension) & ~np.array(batch.column("id").is_null())
    row = np.flatnonzero(there)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    start = column.offsets.to_numpy()[:-1][row]
    vectors = values[start[:, None] + np.arange(dimension)]
    good = np.isfinite(vectors).all(1) & vectors.any(1)
    return ids[row][good].astype(np.int64), vectors[good]


def blocks(vectors: DataFrame, dimension: int, size: int, bits: int = BITS) -> DataFrame:
    """The index: vectors packed ``size`` a row with their codes."""
    turn = rotation(dimension, max(bits, -(-dimension // 64) * 64))

    def pack(ids: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        codes, norms, fit = one_bit_codes(own, turn)
        return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in (("ids", ids), ("vectors", own), ("codes", codes), ("norms", norms), ("fit", fit))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                ids, own = _usable(batch.slice(i, size), dimension)
                held.append((ids, own))
                if sum(len(x) for x, _ in held) >= size:
                    ids, own = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                    held = [(ids[size:], own[size:])]
                    yield pack(ids[:size], own[:size])
        if sum(len(x) for x, _ in held):
            yield pack(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    return vectors.mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A row of the index."""

    def __init__(self, row: dict, dimension: int):
        self.ids, self.norms, self.fit = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("norms", np.float64), ("fit", np.float64)))
        self.vectors, self.codes = np.frombuffer(row["vectors"]).reshape(-1, dimension), np.frombuffer(row["codes"], np.uint64).reshape(len(self.ids), -1)


class Nearest:
    """The k best of all blocks seen so far for each of some queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.bits = ids, queries, k, turn.shape[0]
        self.lengths = lengths(queries)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        turned = queries @ turn.T
        # Of each query the smallest component, the step between its sixteen levels, and the bits of the levels as packed words.
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), np.finfo(np.float64).tiny)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.level_sum = levels.sum(axis=1, dtype=np.int64)
        self.planes = [np.packbits(levels >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(QUERY_BITS)]

    def estimates(self, block: Block, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, how far they may be off), a row a vector and a column a query."""
        ones = np.bitwise_count(block.codes).sum(1, dtype=np.int64)
        weighted = np.zeros((len(block.ids), len(self.low[some])), np.int32)
        for j, plane in enumerate(self.planes):
            for word in range(block.codes.shape[1]):
                weighted += np.bitwise_count(block.codes[:, word, None] & plane[some, word]).astype(np.int32) << j
        low, step = self.low[some], self.step[some]
        among_ones = low * ones[:, None] + step * weighted
        scale = block.norms / block.fit
        guess = (2 * among_ones - (low * self.bits + step * self.level_sum[some])) * (scale / np.sqrt(self.bits))[:, None]
        spread = EPSILON * np.sqrt(np.maximum(0, 1 - block.fit**2) / (self.bits - 1)) * scale
        return guess, spread[:, None] * self.lengths[some] + (EPSILON / np.sqrt(12)) * scale[:, None] * step

    def see(self, block: Block) -> None:
        np.seterr(over="ignore", invalid="ignore")
        for start in range(0, len(self.ids), TOGETHER):
            guess, bound = self.estimates(block, slice(start, start + TOGETHER))
            for j in range(guess.shape[1]):
                q = start + j
                own, (scores, ids) = block.ids != self.ids[q], self.best[q]
                enough, first = scores[-1] if len(scores) == self.k else -np.inf, None
                if len(scores) < self.k:  # the best by estimate tell how good one has to be
                    first = np.argsort(-np.where(own, guess[:, j], -np.inf), kind="stable")[: min(self.k, int(own.sum()))]
                    exact = (block.vectors[first] * self.queries[q]).sum(1)
                    enough = exact.min() if len(first) == self.k else -np.inf
                rows = np.flatnonzero(own & ~(guess[:, j] + bound[:, j] < enough))  # also where the bound is no number
                if first is not None:
                    rows = np.union1d(rows, first)
                exact = np.concatenate([scores, (block.vectors[rows] * self.queries[q]).sum(1)])
                ids = np.concatenate([ids, block.ids[rows]])
                order = np.lexsort((ids, -exact))[: self.k]
                self.best[q] = exact[order], ids[order]


def search(index: DataFrame, queries: DataFrame, dimension: int, k: int = 20, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among the rows of an index made by blocks(). queries: id, vector, different ids."""
    turn = rotation(dimension, max(bits, -(-dimension // 64) * 64))
    asked = written(queries.select("id", "vector"), "ann-queries")
    n_passes = -(-asked.count() // QUERIES_A_PASS)
    spark, parts = index.sparkSession, []
    for number in range(n_passes):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_passes)) == number).toArrow()  # some QUERIES_A_PASS
        ids, vectors = _usable(mine.combine_chunks().to_batches()[0], dimension) if mine.num_rows else (np.zeros(0, np.int64), np.zeros((0, dimension)))
        shared = spark.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Nearest(*shared.value, turn, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    found.see(Block(batch.slice(i, 1).to_pylist()[0], dimension))
            for start in range(0, len(found.ids), 1024):
                rows = found.best[start : start + 1024]
                own = np.repeat(found.ids[start : start + 1024], [len(s) for s, _ in rows])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([i for _, i in rows])), pa.array(np.concatenate([s for s, _ in rows]))], ["query_id", "vec_id", "score"])

        found = index.mapInArrow(run, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(written(found, "ann-found") if n_passes > 1 else found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest(vectors: DataFrame, is_query, k: int = 20, bits: int = BITS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Index all rows and search for those where ``is_query`` holds."""
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), is_query.alias("asks"))
    most = own.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = most["d"] if most else 1
    index = written(blocks(own.select("id", "vector"), dimension, VECTORS_A_BLOCK, bits), "ann-index")
    asking = own.where("asks and id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    return search(index, asking, dimension, k, bits)
