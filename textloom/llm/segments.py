"""Routing of repeated passages: equal windows of texts meet in one task, whatever text they stand in.

A window is ``length`` consecutive units (words or bytes) of one text. Its minimiser is the smallest of
the hashes of the ``gram`` units at its places; neighbouring windows mostly share theirs, and a run of windows with one
minimiser is a segment: their units, and where they start. Equal windows have equal minimisers, so

1. runs whose minimiser no other run has, nor another place of the text, are left out before any text travels;
2. the segments of the others are cut out of their texts and go to shards by minimiser, some BYTES_A_SHARD of different ones to a shard;
3. every shard's index holds each different text once, with the documents that have it, and all segments are streamed against it.

A minimiser with more than BYTES_A_ROUTE of segments is hot: its equal segments are merged before they travel, with their smallest and largest document
and their number, so that no shard depends on how many copies there are. A passage in very many documents also has minimisers whose segments differ in what stands
around the passage. A minimiser with more than BYTES_A_ROUTE of different segments is replaced by longer grams: a window reaches beyond the gram by f units, so it
has (f + 1) / 2 more of them to the right, or as many to the left, and the longer gram on that side, which the window alone decides, becomes its key.
Each window has one key at every length, and the last gram is the window itself, of which there is one segment only: no
shard depends on how many documents share a passage, and nothing is left out on the way.

Merging only saves what is stored and asked twice: equal segments of hot minimisers are told by a digest of 128 bits, others by their bytes in the index.
That a window repeats, and where first, is always an answer of the index that is built for each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mix64, raw, slices, sliding_min, written
from textloom.llm.minhash import word_hashes

#: A shard is closed when it has so many bytes of different segments, or eight times as many of all; a minimiser with more than BYTES_A_ROUTE of segments is merged, and with more than that of different ones it is split.
BYTES_A_SHARD = 1 << 19
BYTES_A_ROUTE = 1 << 18
#: Split minimisers are broadcast up to so many, 8 bytes each; there is at most one for each BYTES_A_ROUTE of segments.
MOST_BROADCAST = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

Index = Callable[[list[bytes], list[int], list[int], list[int]], list[list[tuple[int, int, int]]]]


@dataclass(frozen=True)
class Windows:
    """length: units in a window. gram: units that are hashed, a power of 2. other_documents: only repeats in other documents count."""

    words: bool
    length: int
    gram: int
    other_documents: bool

    def split(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.words else text

    def join(self, units: list[bytes] | bytes) -> bytes:
        return b" ".join(units) if self.words else bytes(units)

    def symbols(self, units: list[bytes] | bytes) -> np.ndarray:
        return word_hashes(units) if self.words else np.frombuffer(units, np.uint8).astype(np.uint64) + np.uint64(1)

    def hashes(self, symbols: np.ndarray, size: int) -> np.ndarray:
        """Hashes of each ``size`` consecutive symbols."""
        out, done = mix64(symbols * _A), 1
        while 2 * done <= size:
            out = mix64(out[:-done] * _B + out[done:])
            done *= 2
        n = len(symbols) - size + 1
        return mix64(out[:n] * _B + out[size - done : size - done + n]) if done < size else out

    def runs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minimiser, first window, windows, whether the minimiser stands in the text twice) of each run.

        In periodic text a minimiser can hold on for ever; a run ends after twice the windows that one gram can be in.
        """
        if len(symbols) < self.length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = self.hashes(symbols, self.gram)
        least = sliding_min(hashes, self.length - self.gram + 1)
        at, new = np.arange(len(least)), np.concatenate([[True], least[1:] != least[:-1]])
        first = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % (2 * (self.length - self.gram + 1)) == 0)
        twice = np.zeros(len(first), np.int64)
        if not self.other_documents:
            hashes = np.append(np.sort(hashes), np.uint64(0))
            place = np.searchsorted(hashes[:-1], least[first])
            twice = (hashes[place + 1] == least[first]) & (place + 1 < len(hashes) - 1)
        return least[first], first, np.diff(np.append(first, len(least))), twice.astype(np.int64)

    def grams(self) -> list[int]:
        """The lengths of the keys of each pass, the window's own last."""
        out = [self.gram]
        while out[-1] < self.length:
            out.append(self.length - (self.length - out[-1]) // 4)
        return out

    def longer(self, symbols: np.ndarray, route: int, anchor: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, windows, place of the key's gram) of each run of a segment, by grams of the next length.

        anchor: the place of the present gram, of ``size`` units, or -1 if it is a minimiser; then it is each window's first place with that hash.
        """
        start, free = np.arange(len(symbols) - self.length + 1), self.length - size
        if anchor < 0:
            places = np.flatnonzero(self.hashes(symbols, size).view(np.int64) == route)
            gram = places[np.searchsorted(places, start)]
        else:
            gram = np.full(len(start), anchor)
        side = np.zeros(len(start), np.uint64)
        for _ in range(2):
            more = (free + 1) // 2
            right = start + free - gram >= more
            gram = np.where(right, gram, gram - more)
            side = side * np.uint64(2) + right
            size, free = size + more, free - more
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (side[1:] != side[:-1])]))
        key = mix64(self.hashes(symbols, size)[gram[first]] * _C + side[first] + np.uint64(4 * size))
        return key, first, np.diff(np.append(first, len(start))), gram[first] - first


def _texts(column: pa.Array) -> list[bytes]:
    data, offsets = raw(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _minimisers(docs: DataFrame, windows: Windows) -> DataFrame:
    """(doc, digest, route, start, n, twice): every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 512 << 10):
            own = [windows.runs(windows.symbols(windows.split(text))) for text in _texts(part.column("text"))]
            row = pa.array(np.repeat(np.arange(len(own)), [len(r[0]) for r in own]))
            columns = [np.concatenate([r[i] for r in own]).view(np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([part.column("doc").take(row), part.column("digest").take(row), *map(pa.array, columns)], ["doc", "digest", "route", "start", "n", "twice"])

    return docs.select("doc", "digest", "text").mapInArrow(run, "doc long, digest long, route long, start long, n long, twice long")


def _cut(texts: DataFrame, windows: Windows) -> DataFrame:
    """Segments of (doc, digest, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 512 << 10):
            rows = []
            for doc, digest, text, runs in zip(part.column("doc").to_pylist(), part.column("digest").to_pylist(), _texts(part.column("text")), part.column("runs").to_pylist(), strict=True):
                units = windows.split(text)
                for r in runs:
                    content = windows.join(units[r["start"] : r["start"] + r["n"] + windows.length - 1])
                    rows.append((doc, digest, r["start"], r["route"], hashlib.blake2b(content, digest_size=16).digest(), content))
            yield _batch(rows, doc=pa.int64(), digest=pa.int64(), start=pa.int64(), route=pa.int64(), content_id=pa.binary(), content=pa.binary())

    return texts.select("doc", "digest", "text", "runs").mapInArrow(run, "doc long, digest long, start long, route long, content_id binary, content binary")


def _hot(sizes: DataFrame, name: str) -> DataFrame:
    """The routes of (route, size) with more than BYTES_A_ROUTE, to be joined."""
    hot = written(sizes.where(F.col("size") > BYTES_A_ROUTE).select("route"), name)
    return F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot


def _merged(segments: DataFrame) -> DataFrame:
    """(route, content_id, anchor, content, doc, last, times, wide): segments, the equal ones of hot routes as one, and whether their route has too many bytes for one index."""
    hot = _hot(segments.groupBy("route").agg(F.sum(F.length("content")).alias("size")), "hot")
    held = segments.select("route", "content_id", "anchor", "content", "doc", "last", "times")
    others = held.join(hot, "route", "left_anti").withColumn("wide", F.lit(False))
    held = held.join(hot, "route", "left_semi").groupBy("route", "content_id").agg(F.first("anchor").alias("anchor"), F.first("content").alias("content"), F.min("doc").alias("doc"), F.max("last").alias("last"), F.sum("times").alias("times"))
    held = written(held, "different")
    wide = _hot(held.groupBy("route").agg(F.sum(F.length("content")).alias("size"), F.count("*").alias("different")).where("different > 1"), "wide")
    known = held.join(wide, "route", "left_anti").withColumn("wide", F.lit(False)).unionByName(held.join(wide, "route", "left_semi").withColumn("wide", F.lit(True)))
    return others.unionByName(known)


def _split(contents: DataFrame, windows: Windows, size: int) -> DataFrame:
    """The segments by longer grams, each with its place in the segment that it is cut from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "content", 64 << 10):
            rows = []
            for text, route, own, anchor, *known in zip(_texts(part.column("content")), *(part.column(c).to_pylist() for c in ("route", "content_id", "anchor", "doc", "last", "times")), strict=True):
                units = windows.split(text)
                keys, first, n, places = windows.longer(windows.symbols(units), route, anchor, size)
                for key, a, k, place in zip(keys.view(np.int64).tolist(), first.tolist(), n.tolist(), places.tolist(), strict=True):
                    content = windows.join(units[a : a + k + windows.length - 1])
                    rows.append((route, own, a, key, hashlib.blake2b(content + place.to_bytes(4, "little"), digest_size=16).digest(), place, content, *known))
            yield _batch(rows, of_route=pa.int64(), of_id=pa.binary(), offset=pa.int64(), route=pa.int64(), content_id=pa.binary(), anchor=pa.int64(), content=pa.binary(), doc=pa.int64(), last=pa.int64(), times=pa.int64())

    return contents.mapInArrow(run, "of_route long, of_id binary, offset long, route long, content_id binary, anchor long, content binary, doc long, last long, times long")


def _searched(contents: DataFrame, windows: Windows, index: Index) -> DataFrame:
    """(route, content_id, first, after, smallest) by the shards' indexes."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = whole = 0

        def answers() -> pa.RecordBatch:
            spans = index([x[5] for x in held], *([x[i] for x in held] for i in (2, 3, 4)))
            new = [not i or x[:2] != held[i - 1][:2] for i, x in enumerate(held)]
            rows = [(x[0], x[1], a, b, d) for x, own, first in zip(held, spans, new, strict=True) if first for a, b, d in own]
            return _batch(rows, route=pa.int64(), content_id=pa.binary(), first=pa.int64(), after=pa.int64(), smallest=pa.int64())

        for part in slices(batches, "content", 256 << 10):
            for row in zip(*(part.column(c).to_pylist() for c in ("route", "content_id", "doc", "last", "times", "content")), strict=True):
                if (size >= BYTES_A_SHARD or whole >= 8 * BYTES_A_SHARD) and row[0] != held[-1][0]:
                    yield answers()
                    held, size, whole = [], 0, 0
                size += len(row[5]) * (not held or row[:2] != held[-1][:2])
                whole += len(row[5])
                held.append(row)
        if held:
            yield answers()

    shards = contents.select("route", "content_id", "doc", "last", "times", "content").repartition(int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route").sortWithinPartitions("route", "content_id")
    return shards.mapInArrow(search, "route long, content_id binary, first long, after long, smallest long")


def _spans(segments: DataFrame, windows: Windows, index: Index, grams: list[int]) -> DataFrame:
    """(route, content_id, spans): the repeated windows of each different segment, as structs of first, after and smallest; a row a segment that has any."""
    contents = _merged(segments)
    last = len(grams) == 1
    found = _searched(contents if last else contents.where("not wide"), windows, index)
    found = found.groupBy("route", "content_id").agg(F.collect_list(F.struct("first", "after", "smallest")).alias("spans"))
    wide = contents.where("wide")
    if last or wide.isEmpty():
        return written(found, "spans")
    parts = written(_split(wide, windows, grams[0]), "parts")
    inner = _spans(parts, windows, index, grams[1:])
    moved = parts.select("of_route", "of_id", "offset", "route", "content_id").join(inner, ["route", "content_id"])
    moved = moved.withColumn("spans", F.transform("spans", lambda s: F.struct((F.col("offset") + s["first"]).alias("first"), (F.col("offset") + s["after"]).alias("after"), s["smallest"].alias("smallest"))))
    moved = moved.groupBy(F.col("of_route").alias("route"), F.col("of_id").alias("content_id")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return written(found.unionByName(moved), "spans")


def removed_repeats(docs: DataFrame, windows: Windows, index: Index, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, digest, n, n_removed, n_spans, kept_sha256, kept): a row for each row of ``docs``; an empty table gives none.

    index: for a shard's segments, the smallest and the largest documents that have them and how often they stand, gives each one's intervals of repeated
    windows, (first, after the last, smallest document), all of them where a larger document than the smallest has the segment. With ``other_documents`` an interval counts for larger documents only, and rows
    with a null id are not touched. digest: xxhash64 of the text. kept: what is left where something is removed, else null.
    """
    text, id_ = F.col(text_column).cast("string"), F.col(id_column).cast("long")
    # doc and digest tell rows apart; the digest has whether the id is null.
    own = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(0)).alias("doc"), F.xxhash64(text, id_.isNull()).alias("digest"), F.xxhash64(text).alias("text_digest"), text.alias("text"))
    taking_part = own.where("doc_id is not null") if windows.other_documents else own
    runs = written(_minimisers(taking_part, windows), "runs")
    again = F.min("doc") < F.max("doc") if windows.other_documents else (F.count("*") > 1) | (F.max("twice") > 0)
    shared = runs.groupBy("route").agg(again.alias("again")).where("again").select("route")
    mine = runs.join(shared, "route", "left_semi").groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "n", "route")).alias("runs"))
    texts = taking_part.groupBy("doc", "digest").agg(F.first("text").alias("text")).join(mine, ["doc", "digest"])
    segments = written(_cut(texts, windows), "segments")

    known = segments.withColumns({"anchor": F.lit(-1).cast("long"), "last": F.col("doc"), "times": F.lit(1).cast("long")})
    spans = _spans(known, windows, index, windows.grams())
    hits = segments.select("doc", "digest", "start", "route", "content_id").join(spans, ["route", "content_id"])
    mine = F.filter("spans", lambda s: s["smallest"] < F.col("doc")) if windows.other_documents else F.col("spans")
    hits = hits.select("doc", "digest", F.transform(mine, lambda s: F.struct((F.col("start") + s["first"]).alias("a"), (F.col("start") + s["after"]).alias("b"))).alias("spans")).where(F.size("spans") > 0)
    hits = hits.groupBy("doc", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            rows = []
            for text, spans in zip(_texts(part.column("text")), part.column("spans").to_pylist(), strict=True):
                units = windows.split(text)
                if not spans:
                    rows.append((len(units), 0, 0, hashlib.sha256(windows.join(units)).hexdigest(), None))
                    continue
                gone = covered(len(units), np.array([(s["a"], s["b"]) for s in spans]), windows.length)
                left = windows.join([w for w, g in zip(units, gone.tolist(), strict=True) if not g]) if windows.words else np.frombuffer(units, np.uint8)[~gone].tobytes()
                rows.append((len(units), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), left))
            out = _batch(rows, n=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept_sha256=pa.string(), kept=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_digest"), *out.columns], ["doc_id", "digest", *out.schema.names])

    left = own.join(hits, ["doc", "digest"], "left").select("doc_id", "text_digest", "text", "spans")
    kept = left.mapInArrow(keep, "doc_id long, digest long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return kept.withColumnRenamed("doc_id", id_column)


def distinct(contents: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different ones, and which of them each one is."""
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(c, len(numbers)) for c in contents], np.int64)
    return list(numbers), which


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` units the windows cover that start in the half-open intervals ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[:, 0], 1)
    np.add.at(edge, starts[:, 1] - 1 + length, -1)
    return np.cumsum(edge)[:n] > 0
