"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one printable character, so a piece of bytes becomes a
piece of characters. A piece's score is its negative rank: sentencepiece's BPE
merges the best-scored neighbours first, leftmost on ties, which is the order
of the ranks. The normaliser is the identity. Pre-tokens are encoded one by
one, and a pre-token that is a piece itself is that piece. Decoding maps each id
back to its bytes.

Nulls and empty texts give no ids. Texts are taken whole. Rows are encoded one by one, so repeated rows and ids do no harm; an empty table gives an empty
one. Other columns are kept as they are, but for those that an operator adds.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

#: How many pre-tokens, none longer than LONG characters, a worker remembers before it starts afresh.
REMEMBERED, LONG = 600_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by piece, from the lines of a rank file: base64 of the piece, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; id 0 is the unknown piece, id r + 1 has rank r."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, b"<unknown piece>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in p).encode()) + _field(2, -float(r)) + _field(3, 1) for r, p in enumerate(by_rank)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts; one a worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        pieces = sorted(self.ranks, key=self.ranks.__getitem__)
        self.blob, self.lengths = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, str] = {}

    def _learn(self, new: list[str]) -> None:
        ask = []
        for t in new:
            rank = self.ranks.get(t.encode())
            if rank is None:
                ask.append(t)
            else:
                self.known[t] = str(rank)
        ids = self.processor.encode([t.encode().decode("latin-1").translate(self.table) for t in ask], num_threads=1)
        self.known.update((t, " ".join([str(i - 1) for i in x])) for t, x in zip(ask, ids, strict=True))

    def encode(self, texts: list[str | None]) -> list[str]:
        """For each text its decimal ids, joined by one space."""
        found = [self.find(t or "") for t in texts]
        new = set().union(*found).difference(self.known)
        if new and len(self.known) > REMEMBERED:
            self.known.clear()
            new = set().union(*found)
        self._learn(list(new))
        out = [" ".join([self.known[t] for t in tokens]) for tokens in found]
        for t in new:
            if len(t) > LONG:
                del self.known[t]
        return out

    def decode(self, encoded: list[str]) -> list[bytes]:
        """The bytes of each text, from its ids."""
        ids = np.fromstring(" ".join(encoded), np.int64, sep=" ")
        length = self.lengths[ids]
        ends = np.cumsum(length)
        data = self.blob[np.repeat(self.starts[ids] - ends + length, length) + np.arange(int(length.sum()))].tobytes()
        stop = np.concatenate([[0], ends])[np.cumsum([s.count(" ") + bool(s) for s in encoded])].tolist()
        return [data[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


_codecs: dict[tuple[int, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec, made on first use."""
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def bpe_tokens(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded): the ids of every whole text as decimals, and the bytes they stand for."""
    return _run(docs, rank_file, pattern, id_column, text_column, digest=False)


def bpe_digests(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as bpe_tokens, with digests in place of ids and bytes."""
    return _run(docs, rank_file, pattern, id_column, text_column, digest=True)


def with_token_ids(docs: DataFrame, rank_file: bytes, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, token_ids and decoded_sha256, the SHA-256 of the bytes the ids stand for."""
    file = docs.sparkSession.sparkContext.broadcast(rank_file)
    others = [c for c in docs.columns if c not in (text_column, "n_tokens", "token_ids", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for part in slices(batches, text_column, 1 << 20):
            ids = own.encode(part.column(text_column).to_pylist())
            n = np.array([s.count(" ") + bool(s) for s in ids])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.fromstring(" ".join(ids), np.int32, sep=" ")))
            sha = pa.array([hashlib.sha256(b).hexdigest() for b in own.decode(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(n, pa.int64()), lists, sha], [*others, "n_tokens", "token_ids", "decoded_sha256"])

    schema = docs.select(*others, F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("token_ids"), F.lit("").alias("decoded_sha256")).schema
    return docs.select(*others, F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, schema)


def _run(docs: DataFrame, rank_file: bytes, pattern: str, id_column: str, text_column: str, digest: bool) -> DataFrame:
    file = docs.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary: its size does not depend on the data
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for part in slices(batches, "text", 1 << 20):
            ids = own.encode(part.column("text").to_pylist())
            n, back = [s.count(" ") + bool(s) for s in ids], own.decode(ids)
            if digest:
                ids, back = [hashlib.sha256(s.encode()).hexdigest() for s in ids], [hashlib.sha256(b).hexdigest() for b in back]
            out = pa.array(back, pa.string() if digest else pa.binary())
            names = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), out], names)

    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids string, decoded binary")
    out = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)
