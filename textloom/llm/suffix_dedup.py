"""Suffix-array dedup by prefix-free parsing.

A shard's segments (see segments.py) are one text of bytes, each segment followed by TRIGGER end marks. Wherever a rolling hash
of TRIGGER bytes is a multiple of MODULUS, or end marks stand, a phrase ends and the next one begins; neighbouring phrases overlap by these
TRIGGER units. The different phrases, sorted, are the dictionary; the sequence of their numbers is the parse. No end of
a phrase that is longer than TRIGGER is the beginning of another one, so the order of all suffixes of
the text follows from two small suffix arrays: first by the suffix of the phrase in which it starts, in the dictionary's order, and
among equal ones by the suffix of the parse that follows. Repetitive text has few phrases.

Strings of WINDOW bytes are equal if they are neighbours in that order and begin with the same WINDOW bytes, which are compared,
eight at a time. Equal segments are in the text once, with their number: a string repeats if the segments of its stretch of the order stand more than once in all.

Every byte goes that is covered by such a string; matches may overlap and lie in one document, never across two. Null texts are empty and keep nothing. Rows equal in id and
text are one document, also where the id is null. An empty table gives an empty one. Texts of any length are cut into segments; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.segments import Windows, distinct, removed_repeats

WINDOW = 200
TRIGGER, MODULUS = 8, 40


def ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 on; equal keys have equal ranks."""
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return rank


def doubled_ranks(symbols: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Ranks of the strings from each place up to its own end, by their first ``longest`` symbols; nothing is smaller than anything.

    As many symbols as fit into a number are sorted at once, then the sorted length is doubled for those that are still equal to others.
    """
    n, bits = len(symbols), int(symbols.max() + 1).bit_length()
    at, key, k = np.arange(n), np.zeros(n, np.int64), 62 // bits
    for i in range(k):
        key <<= bits
        if i < n:
            key[: n - i] += np.where(at[: n - i] + i < end[: n - i], symbols[i:] + 1, 0)
    order = np.argsort(key)
    place, value = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    while True:
        # place: where equal ones stand in the order; value: what was compared; a rank is the first place of those that are equal.
        new = np.concatenate([[True], value[1:] != value[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        own = order[place]
        rank[own] = place[first]
        equal = ~new | np.append(~new[1:], False)
        open_ = equal & (own + k < end[own])
        if k >= longest or not open_.any():
            return rank
        # Strings that have ended stay with the equal ones that go on.
        going = np.logical_or.reduceat(open_, np.flatnonzero(new))[np.cumsum(new) - 1]
        place, own = place[going], own[going]
        after = np.zeros(len(own), np.int64)
        inside = own + k < end[own]
        after[inside] = rank[own[inside] + k] + 1
        value = rank[own] * (n + 2) + after
        by = np.argsort(value)
        order[place], value = own[by], value[by]
        k *= 2


def parse_order(text: np.ndarray, marks: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places ``wanted`` in the order of their suffixes, as far as ``depth`` units tell.

    text: units, 0 for end marks; it ends with TRIGGER of them. marks: the first of each TRIGGER end marks.
    """
    n = len(text)
    roll = np.zeros(n - TRIGGER + 1, np.uint64)
    for i in range(TRIGGER):
        roll = roll * np.uint64(0x100000001B3) + text[i : n - TRIGGER + 1 + i].astype(np.uint64)
    triggers = (roll * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(MODULUS) == 0
    ended = np.concatenate([[0], np.cumsum(text == 0)])
    triggers &= ended[TRIGGER:] == ended[:-TRIGGER]  # not over end marks
    triggers[marks] = True
    triggers[0] = True
    starts = np.flatnonzero(triggers)
    ends = np.append(starts[1:] + TRIGGER, n)[: len(starts)]
    if starts[-1] == n - TRIGGER:
        starts, ends = starts[:-1], ends[:-1]
    data, numbers = text.astype(np.uint16).tobytes(), {}
    parse = np.array([numbers.setdefault(data[2 * a : 2 * b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    length = np.array([len(p) // 2 for p in numbers])
    phrase_end = np.cumsum(length)
    dictionary = np.frombuffer(b"".join(numbers), np.uint16).astype(np.int64)
    suffix = doubled_ranks(dictionary, np.repeat(phrase_end, length), int(length.max()))
    by_rank = ranked(suffix[phrase_end - length])[parse]  # the parse in terms of sorted phrases
    follow = np.append(doubled_ranks(by_rank, np.full(len(parse), len(parse)), min(depth, len(parse))), 0)  # a phrase adds one unit at least
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n - TRIGGER)))[wanted]
    inside = suffix[(phrase_end - length)[parse[owner]] + wanted - starts[owner]]
    return wanted[np.argsort(inside * (len(parse) + 2) + follow[owner + 1])]


def repeated_windows(contents: list[bytes], documents: list[int], lasts: list[int], times: list[int], length: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Of each segment (first window, after the last, 0) for the windows that stand elsewhere."""
    different, which = distinct(contents)
    number = np.bincount(which, weights=times).astype(np.int64)
    size = np.array([len(c) for c in different])
    data = np.frombuffer(b"".join(c + b"\0" * TRIGGER for c in different), np.uint8)
    stop = np.cumsum(size + TRIGGER) - TRIGGER
    text = data.astype(np.int64) + 1
    text[(stop[:, None] + np.arange(TRIGGER)).ravel()] = 0
    room = np.repeat(stop, size + TRIGGER) - np.arange(len(text)) >= length
    order = parse_order(text, stop, np.flatnonzero(room), length)
    left, right = order[:-1], order[1:]
    chunk = np.zeros(len(data), np.uint64)
    for i in range(8):
        chunk[: len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
    same = np.arange(len(left))
    for i in [*range(0, length - 7, 8), length - 8]:
        same = same[chunk[left[same] + i] == chunk[right[same] + i]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    stretch = np.cumsum(new) - 1
    again = np.zeros(len(text), bool)
    again[order] = np.bincount(stretch, weights=np.repeat(number, size + TRIGGER)[order])[stretch] > 1
    out = []
    for begin, end in zip((stop - size).tolist(), (stop - length + 1).tolist(), strict=True):
        edge = np.flatnonzero(np.diff(again[begin:end].astype(np.int8), prepend=0, append=0))
        out.append([(int(a), int(b), 0) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return [out[w] for w in which.tolist()]


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256, kept): a row for each row of ``docs``.

    digest: xxhash64 of the text. kept: the bytes left; null where nothing is removed.
    """
    windows = Windows(words=False, length=WINDOW, gram=64, other_documents=False)
    out = removed_repeats(docs, windows, repeated_windows, id_column, text_column)
    return out.select(F.col(id_column), "digest", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept")
