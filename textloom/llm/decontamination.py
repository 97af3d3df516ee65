"""Benchmark decontamination: training texts are streamed through a generalised suffix automaton of the test items.

Words are runs of letters and digits (every non-ASCII character counts as a letter), ASCII-lower-cased. The automaton is over words: its states are the sets of
places in items where strings of words end. While a text goes through it, the state and the length of the longest match that ends at the word are
kept, however long the text is. An item's windows are its runs of ``window`` words, or the whole item if it is shorter; each is marked at its state. A word is hit if
an occurrence of a window covers it. Hit words are cut out of the text; a text of which more than ``most_coverage`` is hit goes as a whole.

Items are cut into pieces that overlap by a window less a word, and pieces are dealt into shards of some SHARD_BYTES; there is one automaton a shard, broadcast with this bound. A
set of one shard takes one pass over the documents, a larger one a pass for each shard.

Null and empty texts have no words and no hits; null and empty items have no window. Repeated rows get equal results. Items with equal ids count as one; items with a null id hit
words but are not listed. Very long texts are tokenised by CHUNK bytes. Columns other than id and text are not read. An empty table gives an empty result; without items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, written

WINDOW = 10
#: A text goes as a whole if a larger share of its words is hit.
MOST_COVERAGE = 0.8
#: Bytes of item text in one automaton; it has at most as many states as bytes, some 200 bytes each.
SHARD_BYTES = 2 << 20
#: Words of a piece of an item.
PIECE = 4096
CHUNK = 1 << 20
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = "array<struct<start: int, words: int, longest: int>>"


def chunks_of_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of some CHUNK bytes at a time."""
    text, start = text.translate(LETTERS), 0
    while start < len(text):
        end = text.find(b" ", start + CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class Automaton:
    """A generalised suffix automaton of word sequences with the windows that end at its states."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int):
        """pieces: (item id, words)."""
        self.words: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] | None = [{}]
        self.marks: dict[int, dict[int, set]] = {}
        ends: list[tuple[int, int, str | None]] = []
        for item, words in pieces:
            state = 0
            for i, word in enumerate(words):
                state = self._extend(state, self.words.setdefault(word, len(self.words)))
                if i + 1 >= window:
                    ends.append((state, window, item))
            if 0 < len(words) < window:
                ends.append((state, len(words), item))
        for state, n, item in ends:
            while self.length[self.link[state]] >= n:  # the state of the window's own length; splits have moved links since
                state = self.link[state]
            self.marks.setdefault(state, {}).setdefault(n, set()).add(item)
        # From each state the nearest one on its way to the root that has a window.
        self.marked = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]
        n_words = self.n_words = max(1, len(self.words))
        self.step = {state * n_words + word: to for state, steps in enumerate(self.next) for word, to in steps.items()}
        self.next = None
        self.shortest = min((n for lengths in self.marks.values() for n in lengths), default=0)

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(steps)
        return len(self.length) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """The state of the string that is ``state``'s longest with ``word``, taken out of ``to``."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        """Append a word to the string whose state is ``last``."""
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def hits(self, text: bytes) -> tuple[int, list[list[int]], set]:
        """(number of words, [[first word, words, longest match], ...] of maximal hit spans, item ids)."""
        step, link, length, marked, n_words, shortest = self.step, self.link, self.length, self.marked, self.n_words, self.shortest
        done, state, matched, spans, found, seen = 0, 0, 0, [], set(), set()
        for words in chunks_of_words(text):
            for at, word in enumerate(map(self.words.get, words), done):
                if word is None:
                    state = matched = 0
                    continue
                to = step.get(state * n_words + word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state * n_words + word)
                if to is None:
                    matched = 0
                    continue
                state = to
                matched += 1
                if matched < shortest or marked[state] < 0:
                    continue
                longest, mark = 0, marked[state]
                while mark >= 0:
                    for n, items in self.marks[mark].items():
                        if n <= matched:
                            longest = max(longest, n)
                            if (mark, n) not in seen:
                                seen.add((mark, n))
                                found |= items
                    mark = marked[link[mark]]
                if longest:
                    start = at + 1 - longest
                    if spans and start <= spans[-1][0] + spans[-1][1]:
                        start = min(start, spans[-1][0])
                        while len(spans) > 1 and start <= spans[-2][0] + spans[-2][1]:
                            start = min(start, spans[-2][0])
                            spans[-2][2] = max(spans[-2][2], spans[-1][2])
                            spans.pop()
                        spans[-1] = [start, at + 1 - start, max(spans[-1][2], matched)]
                    else:
                        spans.append([start, longest, matched])
            done += len(words)
        return done, spans, found


def without_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the characters from each span's first word to its last one."""
    out, kept, which = [], 0, 0
    for at, m in enumerate(WORD.finditer(text)):
        if which == len(spans):
            break
        start, n = spans[which][0], spans[which][1]
        if at == start:
            out.append(text[kept : m.start()])
        if at == start + n - 1:
            kept = m.end()
            which += 1
    return b"".join(out) + text[kept:]


def pieces_of(items: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(item, words, size): pieces of at most PIECE words, overlapping by a window less a word. Every window stands in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                rows: list[tuple] = []
                for item, text in zip(part.column("item").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    words = (text or b"").translate(LETTERS).split()
                    for start in range(0, max(len(words) - window, 0) + 1, max(1, PIECE - window + 1)):
                        if words:
                            rows.append((item, b" ".join(words[start : start + PIECE])))
                yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.string()), "words": pa.array([r[1] for r in rows], pa.binary()), "size": pa.array([len(r[1]) + 1 for r in rows], pa.int64())})

    own = items.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    return own.mapInArrow(run, "item string, words binary, size long")


def _streamed(docs: DataFrame, pieces: list[tuple], window: int, most_coverage: float | None) -> DataFrame:
    """(id, digest, n_words, spans, items) of each row with id, digest and text; with most_coverage also kept."""
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton([(item, words.split()) for item, words in pieces], window))
    schema = pa.schema([("id", docs_type(docs)), ("digest", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("longest", pa.int32())]))), ("items", pa.list_(pa.string())), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automaton.value
        for part in slices(batches, "text"):
            n_words, spans, items, kept = [], [], [], []
            for text in part.column("text").cast(pa.large_binary()).to_pylist():
                n, found, ids = model.hits(text or b"")
                n_words.append(n)
                spans.append([{"start": a, "words": k, "longest": m} for a, k, m in found])
                items.append(sorted(x for x in ids if x is not None))
                kept.append(cut(text, n, found, most_coverage) if most_coverage is not None else None)
            columns = [part.column("id"), part.column("digest"), n_words, spans, items, kept]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, digest long, n_words long, spans {SPANS}, items array<string>, kept string")


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["id"].dataType)


def cut(text: bytes | None, n_words: int, spans: list[list[int]], most_coverage: float) -> str | None:
    """The text without its spans, empty if they cover too much of it."""
    if not spans:
        return None if text is None else text.decode()
    return "" if sum(s[1] for s in spans) > most_coverage * n_words else without_spans(text, spans).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, n_words, spans, items, kept): one row a row of ``docs``.

    spans: maximal runs of hit words with the longest match that ends in them; items: ids, as sorted strings, of items with a window in the text; kept: the text without its spans.
    """
    pieces = written(pieces_of(items, window, item_id_column, item_text_column), "item-pieces")
    size = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // SHARD_BYTES))
    own = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("digest"), F.col(text_column).alias("text"))

    def shard(k: int) -> list[tuple]:
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_shards)) == k) if n_shards > 1 else pieces
        return [(r["item"], bytes(r["words"])) for r in mine.select("item", "words").collect()]  # some SHARD_BYTES

    if n_shards == 1:
        out = _streamed(own, shard(0), window, most_coverage)
        return out.select(F.col("id").alias(id_column), "n_words", "spans", "items", "kept")
    # A pass for each shard keeps what it hits; a document's spans are merged in its own row's text order.
    passes = [written(_streamed(own, shard(k), window, None).where("size(spans) > 0").dropDuplicates(["id", "digest"]), "shard-hits") for k in range(n_shards)]
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("id", "digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a list for each shard at most
    hits = hits.withColumnsRenamed({"id": "hit_id", "digest": "hit_digest"})
    joined = own.join(hits, own["id"].eqNullSafe(hits["hit_id"]) & (own["digest"] == hits["hit_digest"]), "left")
    kind, id_type = docs.schema[id_column].dataType.simpleString(), docs_type(own)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n_words, spans, kept = [], [], []
            for text, hit in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("hit").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in hit or ():
                    if merged and s["start"] <= merged[-1][0] + merged[-1][1]:
                        merged[-1] = [merged[-1][0], max(merged[-1][1], s["start"] + s["words"] - merged[-1][0]), max(merged[-1][2], s["longest"])]
                    else:
                        merged.append([s["start"], s["words"], s["longest"]])
                n_words.append(sum(map(len, chunks_of_words(text or b""))))
                spans.append([{"start": a, "words": k, "longest": m} for a, k, m in merged])
                kept.append(cut(text, n_words[-1], merged, most_coverage))
            span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("longest", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("id").cast(id_type), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array([x or [] for x in part.column("items").to_pylist()], pa.list_(pa.string())), pa.array(kept, pa.string())], ["id", "n_words", "spans", "items", "kept"])

    merged = joined.select("id", "text", "hit", "items").mapInArrow(merge, f"id {kind}, n_words long, spans {SPANS}, items array<string>, kept string")
    return merged.withColumnRenamed("id", id_column)
