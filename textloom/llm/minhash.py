"""Near-duplicate groups by HyperMinHash.

A document's set are its distinct word shingles, as 64-bit hashes. The first bits of a hash name
one of BUCKETS buckets; a bucket's register holds, for its smallest hash, the number of leading zeros and
the MANTISSA bits after the first one: 16 bits. An empty bucket takes over the register of another one
that is drawn by its number and the attempt, alike for all documents, so that registers agree with the
chance of the Jaccard similarity J in small sets too.

1. Documents with the same set are one class, named by its smallest doc_id. Only classes go on.
2. Bands of ``rows`` registers are keys. In each band's bucket the classes are paired with one of them, the first by a
   hash that differs by band, so that a group of any size makes a pair for each class and band at most.
3. Pairs whose collision-corrected estimate is too low by DEVIATIONS are left out; the others are confirmed on the full sets.
4. Components of the confirmed links. In buckets that now hold several components, blocks of registers are compared with each other: members
   of different components that may be alike are one family, members without any such partner leave.
5. Blocks of a family's full sets are compared, each pair once however many buckets it shares, and only links that connect
   components are passed on; then components are joined. A pair of one bucket is thus examined, unlike by its registers, or already connected; no cap applies.

Sets are made again from the texts for classes that share a bucket; nothing of all documents goes to the driver. What can
be lost is a link whose sets agree in no band (with J = 0.85 and 16 bands of 4 about 8 in a million) or whose estimate falls under
the bound of step 3 (about as many again); for sets of a few shingles, such as J = 6/7 of seven, both together are up to 1 in 10,000.

Words are ASCII-lower-cased runs of anything but ASCII white space. A text of fewer words is one shingle; an empty or
null text has none and is linked with nothing; an empty table gives an empty one. Very long texts are bounded by blocks of BLOCK_BYTES, or one set. Rows of one id are one document when they link. A null id is linked with nothing. Equal rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mix64, slices, written
from textloom.llm.components import connected, joined_components

BUCKETS, MANTISSA, REST = 64, 10, 58
DEVIATIONS = 5.0
ATTEMPTS = 512
#: Words that a worker remembers at most, none longer than LONG bytes.
REMEMBERED, LONG = 500_000, 64
#: Ids are broadcast up to so many, 8 bytes each.
MOST_BROADCAST = 2_000_000
#: Registers, then full sets and their bytes, in a block of a large bucket; hashes in a product.
SKETCHES, BLOCK, BLOCK_BYTES, COLUMNS = 2048, 1024, 8 << 20, 4096
_SOURCE = np.random.default_rng(20).integers(0, BUCKETS, (ATTEMPTS, BUCKETS))
_FACTORS = np.random.default_rng(21).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_word_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers those it has met."""
    if len(_word_hashes) > REMEMBERED:
        _word_hashes.clear()
    new = set(words).difference(_word_hashes)
    for w in new:
        _word_hashes[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    out = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    for w in new:
        if len(w) > LONG:
            del _word_hashes[w]
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles."""
    split = [t.lower().split() for t in texts]
    hashes, at, out = word_hashes([w for words in split for w in words]), 0, []
    for words in split:
        own = hashes[at : at + len(words)]
        at += len(words)
        n = min(k, len(own))
        if not n:
            out.append(own)
            continue
        total = np.full(len(own) - n + 1, n, np.uint64)
        for i in range(n):
            total += own[i : len(own) - n + 1 + i] * _FACTORS[i]
        out.append(np.unique(mix64(total)))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets, a row of BUCKETS 16-bit registers each."""
    out, filled = np.zeros((len(sets), BUCKETS), np.uint16), np.zeros((len(sets), BUCKETS), bool)
    for i, own in enumerate(sets):
        bucket, first = np.unique(own >> np.uint64(REST), return_index=True)  # sorted, so the first is the smallest
        rest = own[first] & np.uint64((1 << REST) - 1)
        length = np.frexp(rest.astype(np.float64))[1]
        mantissa = (rest << (REST - length).astype(np.uint64)) >> np.uint64(REST - 1 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)
        out[i, bucket.astype(int)] = np.minimum(REST - length, 63).astype(np.uint16) << MANTISSA | mantissa.astype(np.uint16)
        filled[i, bucket.astype(int)] = True
    todo, there = np.flatnonzero(~filled.all(1)), filled.copy()
    for attempt in range(ATTEMPTS):
        if not len(todo):
            break
        source = _SOURCE[attempt]
        take = ~filled[todo] & there[todo][:, source]
        out[todo] = np.where(take, out[todo][:, source], out[todo])
        filled[todo] |= take
        todo = todo[~filled[todo].all(1)]
    for i in todo:  # hardly ever: the next bucket that has a hash
        where = np.flatnonzero(there[i])
        for j in np.flatnonzero(~filled[i]):
            out[i, j] = out[i, where[np.searchsorted(where, j) % len(where)]]
    return out


def _lengths(n: np.ndarray) -> np.ndarray:
    """Of each set's size, how likely the smallest hash of a bucket lies in [2^-z-1, 2^-z), by z."""
    return np.diff((1 - 2.0 ** -np.arange(41)[None]) ** np.maximum(n[:, None] / BUCKETS, 1), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, less the agreements that chance alone makes.

    Smallest hashes of different elements agree in zeros z with the chance that both lie in [2^-z-1, 2^-z),
    and in the mantissa once in 2^MANTISSA.
    """
    chance = (_lengths(n_a) * _lengths(n_b)).sum(1) / (1 << MANTISSA)
    return ((a == b).mean(1) - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """As estimate(), for every row of a with every row of b."""
    a, b, same = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(a, b, strict=True):
        same += (x[:, None] == y[None]).view(np.uint8)
    chance = (_lengths(n_a) @ _lengths(n_b).T / (1 << MANTISSA)).astype(np.float32)
    return (same * np.float32(1 / BUCKETS) - chance) / (1 - chance)


def lowest_estimate(threshold: tuple[int, int]) -> float:
    """Pairs below it are not confirmed."""
    least = threshold[0] / threshold[1]
    return least - DEVIATIONS * np.sqrt(least * (1 - least) / BUCKETS)


def sketches(docs: DataFrame, k: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, high, low, sketch): the set's size, a 128-bit digest of it, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch: list = [None] * len(sets)
            for i, r in zip(full, registers([sets[i] for i in full]), strict=True):
                sketch[i] = r.tobytes()
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            high, low = (pa.array([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digest], pa.int64()) for i in (0, 8))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), high, low, pa.array(sketch, pa.binary())], ["doc_id", "n", "high", "low", "sketch"])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, high long, low long, sketch binary")


def _sets_of(docs: DataFrame, nodes: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """(node, n, shingles): the full sets of the classes' documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"])

    own = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    near = F.broadcast(nodes) if nodes.count() <= MOST_BROADCAST else nodes  # otherwise Spark chooses, and may shuffle all texts for a few ids
    return own.join(near.select("node"), "node", "left_semi").mapInArrow(run, "node long, n long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, sketch: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    least = threshold[0] / threshold[1]

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
                n = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
                good = (estimate(a, b, *n) >= lowest_estimate(threshold)) & (np.minimum(*n) >= least * np.maximum(*n) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "shingles_a"):
            good = []
            for x, y in zip(part.column("shingles_a").to_pylist(), part.column("shingles_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(threshold[1] * both >= threshold[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def joined(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            left = left.join(right.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return left

    pairs = joined(pairs, sketch, "n", "sketch").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(promising, "a long, b long")
    return joined(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(similar, "a long, b long")


def pairings(roots: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(some, others): which members of two blocks are compared with which, so that every pair of different roots is.

    side: 0 for members of the first block, 1 for the second; pairs in one side count only if there is no other. Members of the most common root
    are only compared with those of others.
    """
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    values, times = np.unique(roots, return_counts=True)
    few = roots != values[np.argmax(times)]
    if not len(first) or not len(second):
        out = [(np.flatnonzero(few), np.arange(len(roots)))]
    else:
        out = [(first[few[first]], second), (first[~few[first]], second[few[second]])]
    return [(a, b) for a, b in out if len(a) and len(b)]


def common_elements(sets: list[np.ndarray], some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many elements each of some sets has in common with each of others: products of 0/1 matrices over the elements that several sets have."""
    own = [sets[i] for i in [*some, *others]]
    _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared, use = times > 1, times[column] > 1
    row, column = np.repeat(np.arange(len(own)), [len(s) for s in own])[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(some), len(others)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(own), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part[: len(some)] @ part[len(some) :].T
    return both


def block_links(shingles: list[np.ndarray], roots: np.ndarray, side: np.ndarray, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of similar sets of different roots, as many as connect what all such pairs would; roots and side as for pairings()."""
    size = np.array([len(s) for s in shingles], np.float32)
    group, out = {r: r for r in roots.tolist()}, []
    for some, others in pairings(roots, side):
        both = common_elements(shingles, some, others)
        similar = threshold[1] * both >= threshold[0] * (size[some, None] + size[None, others] - both)
        similar &= roots[some, None] != roots[None, others]
        for i, j in np.argwhere(similar).tolist():
            i, j = int(some[i]), int(others[j])
            x, y = int(roots[i]), int(roots[j])
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            while group[y] != y:
                group[y] = group[group[y]]
                y = group[y]
            if x != y:
                group[x] = y
                out.append((i, j))
    return out


def _block_pairs(members: DataFrame, weight: Column) -> DataFrame:
    """(band, key, i, j, node, root, side) from (band, key, node, root): each bucket's members dealt into as many blocks as the weights' sum says, for each pair of its blocks.

    A task compares two blocks, so that neither a bucket nor its pairs stand in one place. Only pairs of blocks with several components are kept.
    """
    size = members.groupBy("band", "key").agg(F.ceil(F.sum(weight)).cast("int").alias("blocks"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "key", "blocks")
    own = members.join(size, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "partner"), "j": F.greatest("own", "partner")})
    several = own.groupBy("band", "key", "i", "j").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "key", "i", "j")
    return own.join(several, ["band", "key", "i", "j"], "left_semi").select("band", "key", "i", "j", "node", "root", (F.col("own") == F.col("j")).cast("int").alias("side"))


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs of blocks over all tasks: they are much work for few bytes, by which Spark would put them together."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "key", "i", "j")


def stars_of(good: np.ndarray) -> list[tuple[int, int]]:
    """(row or len(rows) + column, row): of each component of a 0/1 matrix of links between rows and columns its members with one of its rows."""
    rows, out = good.any(1), []
    while rows.any():
        first = int(np.argmax(rows))
        new_rows, own_rows, own_columns = np.arange(len(rows)) == first, np.zeros(len(rows), bool), np.zeros(good.shape[1], bool)
        while new_rows.any():
            own_rows |= new_rows
            new_columns = good[new_rows].any(0) & ~own_columns
            own_columns |= new_columns
            new_rows = good[:, new_columns].any(1) & ~own_rows
        rows &= ~own_rows
        out += [(i, first) for i in [*np.flatnonzero(own_rows).tolist(), *(len(rows) + np.flatnonzero(own_columns)).tolist()]]
    return out


def _promising(members: DataFrame, sketch: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that connect all members of buckets, from (band, key, node, root), that may be alike and are of different components."""
    least, lowest = threshold[0] / threshold[1], lowest_estimate(threshold)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        side, node, root = (frame[c].to_numpy() for c in ("side", "node", "root"))
        n, rows = frame["n"].to_numpy().astype(np.float64), np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(-1, BUCKETS)
        edges = []
        for some, others in pairings(root, side):
            good = estimates(rows[some], rows[others], n[some], n[others]) >= lowest
            a, b = n[some, None], n[None, others]
            good &= (root[some, None] != root[None, others]) & (least * a <= b + 1e-9) & (least * b <= a + 1e-9)
            both = np.concatenate([node[some], node[others]])
            edges.append(both[np.array(stars_of(good), np.int64).reshape(-1, 2)])
        edges = np.concatenate([*edges, np.zeros((0, 2), np.int64)])
        return pd.DataFrame({"a": edges.max(axis=1), "b": edges.min(axis=1)})

    pairs = _spread(_block_pairs(members, F.lit(1 / SKETCHES)).join(sketch, "node"))
    return pairs.groupBy("band", "key", "i", "j").applyInPandas(lambda frame: compare(frame), "a long, b long").where("a <> b").distinct()


def _links_across(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the components of each family, from (band, key, node, root, n)."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["node"].to_numpy()
        found = block_links([np.frombuffer(x, np.uint64) for x in frame["shingles"]], frame["root"].to_numpy(), frame["side"].to_numpy(), threshold)
        pairs = node[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})

    pairs = _spread(_block_pairs(members, F.greatest(F.lit(1 / BLOCK), F.col("n") * 8 / BLOCK_BYTES)).join(sets, "node"))
    return pairs.groupBy("band", "key", "i", "j").applyInPandas(lambda frame: compare(frame), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of ``docs``.

    Documents are linked if threshold[1] * intersection >= threshold[0] * union of their sets. component_id is
    the smallest doc_id that links reach; kept marks the document that has it.
    """
    rows = 4 if threshold[0] / threshold[1] >= 0.84 else 3
    n_bands = BUCKETS // rows
    sketched = written(sketches(docs, k, rows, id_column, text_column), "sketches")
    full = sketched.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("high", "low", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "classes")
    key = F.substring("sketch", F.col("band") * 2 * rows + 1, F.lit(2 * rows))
    banded = classes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("band")).select("node", "band", key.alias("key"))
    # Each band's bucket and its first class by a hash of the band's own.
    first = F.struct(F.xxhash64("band", "node").alias("h"), F.col("node").alias("node"))
    shared = banded.groupBy("band", "key").agg(F.min(first).alias("first"), F.count("*").alias("size")).where("size > 1").select("band", "key", F.col("first.node").alias("center"))
    buckets = written(banded.join(shared, ["band", "key"]), "buckets")
    stars = buckets.where("node <> center").select(F.greatest("node", "center").alias("a"), F.least("node", "center").alias("b")).distinct()
    inside = written(buckets.select("node").distinct(), "inside")
    sketch = classes.groupBy("node").agg(F.max("n").alias("n"), F.max_by("sketch", "n").alias("sketch")).join(inside, "node", "left_semi")
    sketch = written(sketch, "bucket-sketches")
    sets = _sets_of(docs, inside, k, id_column, text_column)
    sets = written(sets.groupBy("node").agg(F.max_by("shingles", "n").alias("shingles")), "sets")
    links = written(_confirmed(stars, sets, sketch, threshold), "links")
    roots = written(connected(links), "roots")

    rooted = lambda table, roots: table.select("band", "key", "node").join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    placed = rooted(buckets, roots)
    open_ = placed.groupBy("band", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band", "key")
    families = written(_promising(placed.join(open_, ["band", "key"], "left_semi"), sketch, threshold), "families")
    if not families.isEmpty():
        families = connected(families).select(F.lit(0).alias("band"), F.col("root").alias("key"), "node")
        left = rooted(families, roots).join(sketch.select("node", "n"), "node")
        links = written(_links_across(written(left, "families"), sets, threshold), "links")
        roots = written(joined_components(roots, links), "roots")

    member = full.select("high", "low", "n", "doc_id").distinct().join(classes.select("high", "low", "n", "node"), ["high", "low", "n"])
    member = member.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
