"""Segmentation of texts into spans: tokens, sentences, paragraphs.

A span table has doc_id, idx (its place in the document), start and end: code points, end exclusive. Segmenting is one pass over
the documents without a shuffle; regular expressions run on Arrow batches, since offsets are wanted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pieces = Iterator[tuple[int, int]]


def _matches(pattern: str) -> Callable[[str], Pieces]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _between(pattern: str) -> Callable[[str], Pieces]:
    """The pieces between matches."""
    compiled = re.compile(pattern)

    def pieces(text: str) -> Pieces:
        at = 0
        for m in compiled.finditer(text):
            yield at, m.start()
            at = m.end()
        yield at, len(text)

    return pieces


def _cut_before(pattern: str) -> Callable[[str], Pieces]:
    """Pieces that begin where a match begins."""
    compiled = re.compile(pattern)

    def pieces(text: str) -> Pieces:
        edges = [0, *(m.start() for m in compiled.finditer(text) if m.start()), len(text)]
        return zip(edges, edges[1:], strict=False)

    return pieces


#: Sentences end with their stops; white space after them belongs to neither.
AFTER_STOPS = r"[^\s.!?][^.!?]*+[.!?]++|[.!?]++|[^\s.!?](?:[^.!?]*[^\s.!?])?"


def careful_words(
    abbreviations: tuple[str, ...] = (), misc: tuple[str, ...] = (r"\S+@\S+\.\S+", r"https?://\S+"), number: str = r"\d+(?:[.,:]\d+)*%?", start: str = "\"'([{<«“‘’", within: str = "-'’_", end: str = ".,;:!?\"')]}>»“”‘’…",
    tokens: tuple[str, ...] = (), multi: tuple[str, ...] = (), case_sensitive: bool = False,
) -> Callable[[str], Pieces]:
    """Words with what stands at their start and end split off.

    misc: patterns kept whole. multi: patterns of punctuation that are one token wherever they stand. number: kept whole. start, end: characters split off at a word's start and end. within: characters that join parts
    of a word. A final full stop stays with a word that is an abbreviation. tokens: words that are kept whole though the rules would cut them, such as models.split_token_list() gives.
    """
    fold = (lambda w: w) if case_sensitive else str.lower
    known, kept = {fold(a) for a in abbreviations}, {fold(t) for t in tokens}
    special = [*misc, *multi, number]
    whole = re.compile("|".join(f"(?:{p})" for p in special) + rf"|\w+(?:[{re.escape(within)}]\w+)*|[^\w\s]")
    together = "|".join(f"(?:{p})" for p in multi)
    at_start, at_end = (re.compile(together), re.compile(f"(?:{together})$")) if multi else (None, None)
    compact = re.compile(r"\S+")

    def pieces(text: str) -> Pieces:
        for m in compact.finditer(text):
            a, b = m.span()
            while a < b and fold(text[a:b]) not in kept:
                first = at_start.match(text, a, b) if at_start else None
                step = first.end() if first and first.end() > a else a + 1 if text[a] in start else a
                if step == a:
                    break
                yield a, step
                a = step
            tail = []
            while b > a and fold(text[a:b]) not in known and fold(text[a:b]) not in kept:
                last = at_end.search(text[:b], a) if at_end else None
                step = last.start() if last and last.end() > last.start() else b - 1 if text[b - 1] in end else b
                if step == b:
                    break
                tail.append((step, b))
                b = step
            if a < b and (fold(text[a:b]) in known or fold(text[a:b]) in kept):
                yield a, b
            else:
                yield from (x.span() for x in whole.finditer(text, a, b))
            yield from reversed(tail)

    return pieces


def trained_sentences(abbreviations: tuple[str, ...] = (), starters: tuple[str, ...] = (), collocations: tuple[tuple[str, str], ...] = ()) -> Callable[[str], Pieces]:
    """Sentences by stops: none after a single letter or an abbreviation, but for one before a capitalised starter, none between the two words of a collocation, none before a lower-case word unless it is a starter.

    In collocations a number is written ``##number##``.
    """
    known, begin, together = {a.lower().rstrip(".") for a in abbreviations}, {s.lower() for s in starters}, set(collocations)
    stop = re.compile(r"((?:\w+\.)*\w*)[.!?…]+[\"'”’)\]]*(?=\s+(\S+))")

    def pieces(text: str) -> Pieces:
        at = 0
        for m in stop.finditer(text):
            word, following = m[1].lower(), m[2].strip("\"'“”‘’([")
            last, bare = word.rpartition(".")[2], re.sub(r"\W+$", "", following).lower()
            if text[m.end(1)] == ".":
                if ("##number##" if word[:1].isdigit() else word, bare) in together or len(last) == 1 and last.isalpha() and word not in known:
                    continue
                if word in known and not (following[:1].isupper() and bare in begin):
                    continue
            if following[:1].islower() and bare not in begin:
                continue
            yield at, m.end()
            at = m.end()
        yield at, len(text)

    return pieces


SEGMENTERS: dict[str, Callable[[str], Pieces]] = {
    "whitespace": _matches(r"\S+"),
    "ascii_whitespace": _matches(r"[^ \n\t\r\f\v]+"),
    "words_and_punctuation": _matches(r"\w+|[^\w\s]+"),
    "blank_lines": _between(r"\s*\n\s*\n\s*"),
    "line_breaks": _between(r"\s*\n\s*"),
    "stops": _matches(AFTER_STOPS),
    "section_signs": _cut_before(r"(?m)^\.*§"),
    "careful_words": careful_words(),
    "trained_sentences": trained_sentences(),
}


#: Segmenters whose pieces are as they are wanted: none begins or ends with what it takes for white space.
TIGHT = ("whitespace", "ascii_whitespace", "words_and_punctuation", "stops")
#: Texts of so many bytes are cut at a time.
BYTES_AT_A_TIME = 1 << 20


def _cutter(segmenter: str | Callable[[str], Pieces]) -> Callable[[str], list[tuple[int, int]]]:
    """A function to the spans of a text without white space around them; blank ones are left out."""
    cut = SEGMENTERS[segmenter] if isinstance(segmenter, str) else segmenter
    if segmenter in TIGHT:
        return lambda text: list(cut(text))

    def spans(text: str) -> list[tuple[int, int]]:
        out = []
        for a, b in cut(text):
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
        return out

    return spans


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have BYTES_AT_A_TIME at most, or are one."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_A_TIME, "right")))
            yield batch.slice(at, end - at)
            at = end


def _span_columns(ids: pa.Array, lists: list[list[tuple[int, int]]]) -> list[pa.Array]:
    """doc_id, idx, start and end of all spans."""
    n = np.array([len(x) for x in lists], np.int64)
    edges = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int32, 2 * int(n.sum())).reshape(-1, 2)
    idx = np.arange(len(edges)) - np.repeat(np.cumsum(n) - n, n)
    return [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), *(pa.array(np.ascontiguousarray(c, np.int32)) for c in (idx, edges[:, 0], edges[:, 1]))]


def segment(docs: DataFrame, segmenter: str | Callable[[str], Pieces] = "whitespace", chunks: DataFrame | None = None, existing: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, idx, start, end): the spans of every text, without surrounding white space; blank ones are left out.

    chunks: spans whose edges no segment may cross. existing: spans that are kept; only what lies between them is segmented.
    A null text has no spans. Each document is handled in one task, some megabyte of texts at a time.
    """
    cut = _cutter(segmenter)
    own = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    for name, spans in (("chunks", chunks), ("kept", existing)):
        if spans is None:
            own = own.withColumn(name, F.array().cast("array<struct<start:int,end:int>>"))
        else:
            lists = spans.groupBy(F.col("doc_id").alias("span_doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(name))
            own = own.join(lists, own["doc_id"] == lists["span_doc"], "left").drop("span_doc")

    def spans_of(text: str, chunks: list[dict], kept: list[dict]) -> list[tuple[int, int]]:
        fixed = [(k["start"], k["end"]) for k in kept]
        edges = {0, len(text), *(e for c in chunks for e in (c["start"], c["end"])), *(e for k in fixed for e in k)}
        edges = sorted(e for e in edges if 0 <= e <= len(text))
        inside, out = 0, list(fixed)
        for a, b in zip(edges, edges[1:], strict=False):
            while inside < len(fixed) and fixed[inside][1] <= a:
                inside += 1
            if inside < len(fixed) and fixed[inside][0] <= a and b <= fixed[inside][1]:
                continue
            out += [(a + x, a + y) for x, y in cut(text[a:b])]
        return sorted(out)

    whole = chunks is None and existing is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = part.column("text").to_pylist()
            lists = [cut(t) for t in texts] if whole else [spans_of(t, c or [], k or []) for t, c, k in zip(texts, part.column("chunks").to_pylist(), part.column("kept").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(_span_columns(part.column("doc_id"), lists), ["doc_id", "idx", "start", "end"])

    return own.select("doc_id", "text", "chunks", "kept").mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, idx int, start int, end int")


def piece_counts(docs: DataFrame, segmenter: str | Callable[[str], Pieces] = "whitespace", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n): a row for each row of docs with the number of its text's spans: 0 if there are none, null for a null text."""
    cut = _cutter(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [None if t is None else len(cut(t.as_py())) for t in (x if x.is_valid else None for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n"])

    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n long")


def token_table(docs: DataFrame, segmenter: str | Callable[[str], Pieces] = "words_and_punctuation", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, idx, start, end, word) in one pass: segmenting and the spans' text together."""
    cut = _cutter(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = part.column("text").to_pylist()
            lists = [cut(t) for t in texts]
            words = pa.array([t[a:b] for t, spans in zip(texts, lists, strict=True) for a, b in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*_span_columns(part.column("doc_id"), lists), words], ["doc_id", "idx", "start", "end", "word"])

    own = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, idx int, start int, end int, word string")


def token_lines(docs: DataFrame, segmenter: str | Callable[[str], Pieces] = "words_and_punctuation", outer: str | Callable[[str], Pieces] | None = None, size: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, sentence, first, words): a row for each run of tokens of one sentence, gathered where the text is segmented, so that no exchange is needed. first: the idx of its first token.

    Sentences are the spans of ``outer``, by their idx; runs of tokens in none of them, or over an edge, have null. Without it they are ``size`` tokens each, numbered from 0.
    """
    cut, cut_outer = _cutter(segmenter), _cutter(outer) if outer is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            texts = part.column("text").to_pylist()
            lists = [cut(t) for t in texts]
            words = pa.array([t[a:b] for t, spans in zip(texts, lists, strict=True) for a, b in spans], pa.string())
            n = np.array([len(x) for x in lists], np.int64)
            owner, idx = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if cut_outer is None:
                sentence, none = idx // size, np.zeros(len(idx), bool)
            else:
                edges = [_span_columns(pa.array(range(len(texts))), x) for x in (lists, [cut_outer(t) for t in texts])]
                base = np.cumsum([0, *(len(t) + 1 for t in texts)])
                (ts, te), (us, ue) = ([c.to_numpy().astype(np.int64) + base[own.to_numpy()] for c in (start, end)] for own, _, start, end in edges)
                at = np.searchsorted(us, ts, "right") - 1
                inside = (at >= 0) & (te <= ue[at]) if len(us) else np.zeros(len(ts), bool)
                sentence, none = np.where(inside, edges[1][1].to_numpy()[at] if len(us) else 0, -1), ~inside
            begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (sentence[1:] != sentence[:-1])])) if len(idx) else np.zeros(0, np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.append(begins, len(idx)), pa.int32()), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner[begins])), pa.array(sentence[begins], pa.int32(), mask=none[begins]), pa.array(idx[begins], pa.int32()), rows], ["doc_id", "sentence", "first", "words"]
            )

    own = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, sentence int, first int, words array<string>")
