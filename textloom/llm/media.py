"""AVI motion-JPEG: store bytes losslessly, read them back, and find shots.

A payload byte is one quantised DCT coefficient of a baseline JPEG block, 64 a
block, in zigzag order; the quantisers are 1. The coefficients used are those of eight bits:
128..255 for the byte itself, -255..-128 for bytes 0..127. JPEG writes such a
coefficient as the code of "no zeros, eight bits" followed by just the byte. The
Huffman tables hold that one code, eight zero bits; each block is a restart
interval of its own. Frames are 32 by 32 samples, the last one filled up with zero bytes;
the file's INFO list has the payload's length. Any JPEG reader can decode the frames.

Reading parses the RIFF lists, finds the frames by the idx1 index, decodes the
coefficients (tables of one code at once, any other baseline grey frame bit by bit),
and transforms them to samples. A shot begins where the histograms of neighbouring frames differ by more
than the mean and three deviations of the differences just before; the first two differences of a file are only looked back on.

A null payload counts as empty. Rows are handled one by one, so repeated rows and ids do no harm. An empty table gives an empty one. Media that can't be read
(damaged, cut off, no AVI, colour or progressive frames) give one row that says why; they don't stop the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import raw, slices

SIDE = 32
BLOCKS = SIDE * SIDE // 64
MICROSECONDS = 40_000
BINS = 16
#: Differences that the adaptive threshold looks back on, and the least difference of a cut.
BACK, LEAST_CUT = 12, 0.12


def _zigzag() -> list[int]:
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return [8 * y + x for y, x in cells]


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


ZIGZAG = np.array(_zigzag())
ONE_CODE = bytes([0] * 7 + [1] + [0] * 8) + b"\x08"
HEADER = (
    b"\xff\xd8"
    + _marker(0xDB, b"\x00" + b"\x01" * 64)
    + _marker(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _marker(0xC4, b"\x00" + ONE_CODE)
    + _marker(0xC4, b"\x10" + ONE_CODE)
    + _marker(0xDD, b"\x00\x01")
    + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _inverse_dct() -> np.ndarray:
    """From 64 zigzag coefficients to 64 samples in reading order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k, 1, np.sqrt(0.5))
    return np.einsum("ky,lx->klyx", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _inverse_dct()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames' coefficients are the payload, a multiple of 64 bytes."""
    if len(payload) % 64 or not payload:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = -(-len(payload) // (64 * BLOCKS))
    blocks = np.zeros((n * BLOCKS, 130), np.uint8)
    blocks[:, 1:128:2] = np.frombuffer(payload.ljust(n * 64 * BLOCKS, b"\0"), np.uint8).reshape(-1, 64)
    blocks[:, 128] = 255
    blocks[:, 129] = 0xD0 + np.arange(len(blocks)) % BLOCKS % 8
    blocks[BLOCKS - 1 :: BLOCKS, 129] = 0xD9
    if b"\xff" in payload:  # such a byte is followed by a zero in a JPEG stream
        frames = []
        for f in range(n):
            own = [(b[:128].tobytes().replace(b"\xff", b"\xff\0") + b[128:].tobytes()) for b in blocks[f * BLOCKS : (f + 1) * BLOCKS]]
            frames.append(HEADER + b"".join(own))
        movi = b"".join(_chunk(b"00dc", f) for f in frames)
        size = np.array([len(f) for f in frames])
    else:
        size = np.full(n, len(HEADER) + 130 * BLOCKS)
        head = b"00dc" + struct.pack("<I", size[0]) + HEADER
        whole = np.zeros((n, len(head) + 130 * BLOCKS + size[0] % 2), np.uint8)
        whole[:, : len(head)] = np.frombuffer(head, np.uint8)
        whole[:, len(head) : len(head) + 130 * BLOCKS] = blocks.reshape(n, -1)
        movi = whole.tobytes()
    step = 8 + size + size % 2
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 16
    index[:, 2], index[:, 3] = 4 + np.cumsum(step) - step, size
    avih = struct.pack("<14I", MICROSECONDS, 0, 0, 16, n, 0, 1, int(size.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, n, int(size.max()), 0, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + header + info + _list(b"movi", movi) + _chunk(b"idx1", index.tobytes()))


def read_riff(data: bytes) -> dict:
    """microseconds a frame, payload length if told, and (offset, size) of each frame by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"microseconds": MICROSECONDS, "payload": None, "frames": []}
    todo, movi, index = [(12, 8 + struct.unpack_from("<I", data, 4)[0])], None, None
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = (body, body + size)
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                found["microseconds"] = struct.unpack_from("<I", data, body)[0]
            elif name == b"ICMT" and data[body : body + 8] == b"payload=":
                found["payload"] = int(data[body + 8 : body + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, body).reshape(-1, 4).astype(np.int64)
            at = body + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1 index")
    index = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    base = movi[0] if not len(index) or data[movi[0] + index[0, 2] : movi[0] + index[0, 2] + 4] == b"00dc" else 0
    found["frames"] = [(base + o + 8, s) for o, s in index[:, 2:].tolist()]
    return found


def parse_jpeg(frame: bytes) -> dict:
    """Height, width, tables, restart interval, and where the coded data begin, of a baseline grey JPEG."""
    out: dict = {"restart": 0, "huffman": {}, "quantisers": {}}
    at = 2
    while at + 4 <= len(frame):
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if kind == 0xDB:
            while body:
                out["quantisers"][body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
                body = body[65:]
        elif kind == 0xC0:
            out["height"], out["width"], parts = struct.unpack(">HHB", body[1:6])
            if parts != 1:
                raise ValueError("only grey frames are read")
            out["table"] = body[8]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                symbols, code, table, k = body[17 : 17 + sum(counts)], 0, {}, 0
                for length, m in enumerate(counts, 1):
                    for _ in range(m):
                        table[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huffman"][body[0]] = table
                body = body[17 + len(symbols) :]
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            out["dc"], out["ac"], out["data"] = out["huffman"][body[2] >> 4], out["huffman"][16 | body[2] & 15], at + 2 + size
            return out
        at += 2 + size
    raise ValueError("no scan")


def _blocks_bit_by_bit(frame: bytes, head: dict) -> np.ndarray:
    """Quantised coefficients of any baseline grey frame, blocks by 64 in zigzag order."""
    n = -(-head["height"] // 8) * -(-head["width"] // 8)
    out, block, at = np.zeros((n, 64), np.int16), 0, head["data"]
    while block < n:
        stop = at  # the coded data up to the next marker
        while frame[stop] != 255 or frame[stop + 1] == 0:
            stop += 1
        data = frame[at:stop].replace(b"\xff\0", b"\xff")
        bits, place = int.from_bytes(data), 8 * len(data)
        at, before = stop + 2, 0

        def take(k: int, bits: int = bits) -> int:
            nonlocal place
            place -= k
            return bits >> place & (1 << k) - 1

        def symbol(table: dict) -> int:
            code = length = 0
            while (length, code) not in table:
                code, length = code << 1 | take(1), length + 1  # noqa: B023
                if length > 16:
                    raise ValueError("no such code")
            return table[length, code]

        def value(k: int) -> int:
            v = take(k) if k else 0  # noqa: B023
            return v if not k or v >> k - 1 else v - (1 << k) + 1

        for _ in range(min(head["restart"] or n, n - block)):
            before += value(symbol(head["dc"]))
            out[block, 0], k = before, 1
            while k < 64:
                run = symbol(head["ac"])
                if not run:
                    break
                k += run >> 4
                if run & 15:
                    out[block, k] = value(run & 15)
                k += 1
            block += 1
    return out


def decode_frames(data: bytes, places: list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each frame the quantised coefficients, and the histogram of its samples."""
    view, heads, quick = np.frombuffer(data, np.uint8), {}, {}
    coefficients: list = [None] * len(places)
    for i, (at, size) in enumerate(places):
        start = data.find(b"\xff\xda", at, at + size)
        key = data[at : start + 2 + struct.unpack_from(">H", data, start + 2)[0]] if start >= 0 else b""
        if key not in heads:
            heads[key] = parse_jpeg(data[at : at + size])
        head = heads[key]
        blocks = -(-head["height"] // 8) * -(-head["width"] // 8)
        if size == head["data"] + 130 * blocks and head["restart"] == 1 and head["dc"] == head["ac"] == {(8, 0): 8}:
            quick.setdefault((key, size), []).append(i)
        else:
            coefficients[i] = _blocks_bit_by_bit(data[at : at + size], head)
    for (key, size), frames in quick.items():
        head = heads[key]
        starts = np.array([places[i][0] for i in frames]) + head["data"]
        own = view[starts[:, None] + np.arange(size - head["data"])].reshape(len(frames), -1, 130)
        if own[:, :, 0:128:2].any() or (own[:, :, 1:128:2] == 255).any():
            raise ValueError("a frame's coded data are damaged")
        byte = own[:, :, 1:128:2].astype(np.int16)
        value = np.where(byte < 128, byte - 255, byte)
        for i, v in zip(frames, value, strict=True):
            coefficients[i] = v
    histograms = np.zeros((len(places), BINS))
    for i0 in range(0, len(places), 512):
        own = coefficients[i0 : i0 + 512]
        samples = np.rint(np.concatenate(own).astype(np.float32) @ INVERSE + np.float32(128)).clip(0, 255).astype(np.int64)
        frame = np.repeat(np.arange(len(own)), [len(c) for c in own])
        counts = np.bincount((frame[:, None] * BINS + samples // (256 // BINS)).ravel(), minlength=len(own) * BINS).reshape(-1, BINS)
        histograms[i0 : i0 + 512] = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return coefficients, histograms


def shot_starts(histograms: np.ndarray) -> list[int]:
    """First frames of the shots: frame 0, and each that differs from the one before by more than usual."""
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    t = np.arange(len(d))
    first = np.maximum(0, t - BACK)
    n = np.maximum(1, t - first)
    mean = (s[t] - s[first]) / n
    limit = mean + 3 * np.sqrt(np.maximum(0, (q[t] - q[first]) / n - mean * mean))
    cut = (t - first >= 2) & (d > np.maximum(limit, LEAST_CUT))
    return [0, *(np.flatnonzero(cut) + 1).tolist()] if len(histograms) else []


def decode_avi(data: bytes) -> tuple[bytes, list[tuple[int, int]], int]:
    """The payload, the shots as (first frame, frame after the last), and microseconds a frame."""
    riff = read_riff(data)
    coefficients, histograms = decode_frames(data, riff["frames"])
    value = np.concatenate(coefficients) if coefficients else np.zeros((0, 64), np.int16)
    payload = np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()
    starts = shot_starts(histograms)
    return payload[: riff["payload"]], list(zip(starts, [*starts[1:], len(histograms)], strict=False)), riff["microseconds"]


def _padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = raw(batch.column("text"))
    whole = data.tobytes()
    return (whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def store_avi(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, media): each whole text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            media = pa.array([encode_avi(_padded(t)) for t in _texts(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), media], ["id", "media"])

    out = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_column]}, media binary")
    return out.withColumnRenamed("id", id_column)


def avi_clips(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id, clip, first_frame, last_frame, start_s, end_s, error): the shots of each AVI file; none for a null, and for media that can't be read one row with only the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = []
            for key, data in zip(part.column("id").to_pylist(), part.column("media").to_pylist(), strict=True):
                if data is not None:
                    try:
                        _, shots, us = decode_avi(data)
                        rows += [(key, k, a, b - 1, a * us / 1e6, b * us / 1e6, None) for k, (a, b) in enumerate(shots)]
                    except (ValueError, KeyError, IndexError, struct.error) as problem:
                        rows.append((key, None, None, None, None, None, f"{type(problem).__name__}: {problem}"))
            kinds = [part.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "clip", "first_frame", "last_frame", "start_s", "end_s", "error"])

    schema = f"id {dict(media.dtypes)[id_column]}, clip int, first_frame long, last_frame long, start_s double, end_s double, error string"
    return media.select(media[id_column].alias("id"), media[media_column].alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def avi_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text stored as AVI, read back and digested; the media never leave their task."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(text: bytes) -> tuple:
        media = encode_avi(_padded(text))
        payload, shots, us = decode_avi(media)
        feature = f"frames={shots[-1][1]};shots={len(shots)};clips=" + ",".join(f"{a * us // 1000}-{b * us // 1000}" for a, b in shots)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for part in slices(batches, "text", 1 << 20):
            columns = zip(*map(digest, _texts(part)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = f"id {dict(docs.dtypes)[id_column]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)
