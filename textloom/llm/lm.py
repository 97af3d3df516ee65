"""Language-model scoring by prediction by partial matching (PPM), with a word model beside it.

The byte model is a trie of contexts of up to three bytes, trained on all training
texts. A symbol seen after a context has the share count / (n + t), n the context's
occurrences and t its distinct symbols (PPM's method C); t / (n + t) is the
chance of an escape to the context one byte shorter, where the symbols
already seen are excluded; below the empty context all bytes left are equally likely. As a
longer context's symbols are all among the shorter one's, every context's whole
distribution can be worked out beforehand, and a text's code length is one table look-up a byte.

Training counts strings of four bytes on the executors, sums them up in a shuffle, and derives the shorter ones
there. Every counted string stays in the model, which is a table and grows with the corpus. The whole distributions
of the most frequent contexts, of CONTEXTS contexts and NODES strings a length at most, are broadcast; what a text holds after other contexts is
counted by text, its chances are worked out by joins with the table of strings, and joined. Both give the same chances. Every text starts
after three zero bytes.

The word model is a table of counts. Frequent words, KNOWN at most and of bounded length, are broadcast; the others
are joined. Texts are whole, with A-Z lower-cased. A null text is empty: score 0, one token (the end). Rows with
equal ids are kept apart; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import raw, slices, written

#: Of each length, so many contexts with so many strings in all are broadcast at most; the others are joined.
NODES, CONTEXTS = 1 << 20, 1 << 15
KNOWN, KNOWN_BYTES = 1 << 18, 64
DEPTH = 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A task passes on its counts when it holds so many words.
HELD_WORDS = 300_000


def positions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols, lengths): of every byte of the lower-cased texts the three bytes before it and itself."""
    data, offsets = raw(column)
    length = np.diff(offsets)
    padded = np.zeros(len(data) + DEPTH * len(length), np.uint8)
    at = np.arange(len(data)) + DEPTH * np.repeat(np.arange(1, len(length) + 1), length)
    padded[at] = LOWER[data]
    wide = padded.astype(np.uint32)
    context = (wide[at - 3] << np.uint32(16)) | (wide[at - 2] << np.uint32(8)) | wide[at - 1]
    return context, padded[at], length


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def corpus_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, word, n): how often each string of four bytes, as a number, and each word stands in the texts."""

    def batches(grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(grams), 50_000):
            g = pa.array(grams[i : i + 50_000].astype(np.int64))
            yield pa.RecordBatch.from_arrays([g, pa.nulls(len(g), pa.binary()), pa.array(n[i : i + 50_000].astype(np.int64))], ["gram", "word", "n"])

    def words(counts: Counter) -> Iterator[pa.RecordBatch]:
        keys, n = list(counts), list(counts.values())
        for i in range(0, len(keys), 50_000):
            w = pa.array(keys[i : i + 50_000], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), w, pa.array(n[i : i + 50_000], pa.int64())], ["gram", "word", "n"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        counts: Counter = Counter()
        for part in slices(rows, "text", 2 << 20):
            context, symbol, _ = positions(part.column("text"))
            gram, n = np.unique((context << np.uint32(8)) | symbol, return_counts=True)
            parts.append((gram, n))
            if len(parts) > 8:
                parts = [_merge(parts)]
            for text in part.column("text").cast(pa.binary()).to_pylist():
                counts.update((text or b"").lower().split())
            if len(counts) > HELD_WORDS:
                yield from words(counts)
                counts = Counter()
        yield from words(counts)
        if parts:
            yield from batches(*_merge(parts))

    out = docs.select(docs[text_column].cast("string").alias("text")).mapInArrow(run, "gram long, word binary, n long")
    return out.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def ppm_table(children: list[tuple[np.ndarray, np.ndarray]], context_count: int) -> dict[str, np.ndarray]:
    """All contexts' distributions, from the kept strings of 1 to 4 bytes as (numbers, counts), shortest first.

    context_count: what a context must have to get a row. Returns contexts0..3 with the contexts' numbers, whose
    rows follow each other, and logs: log10 of each byte's chance by row.
    """
    rows, seen = [], []
    for depth, (gram, n) in enumerate(children):
        context, symbol = gram >> 8, gram & 255
        known, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, n, len(known)) if len(known) else np.zeros(0)
        kept = (total >= context_count) | (depth == 0)
        place = np.cumsum(kept) - 1
        counts = np.zeros((int(kept.sum()), 256))
        use = kept[at] if len(known) else np.zeros(0, bool)
        counts[place[at[use]], symbol[use]] = n[use]
        if depth == 0 and not len(counts):
            known, kept, counts = np.zeros(1, np.int64), np.ones(1, bool), np.zeros((1, 256))
        rows.append(known[kept])
        seen.append(counts)

    def chances(depth: int, row: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The distribution after the contexts ``row`` of that depth over the bytes that are not ``out``."""
        if depth < 0:
            return ~out / np.maximum(1, (~out).sum(1, keepdims=True))
        counts = np.where(out, 0, seen[depth][row])
        n, t = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        new = out | (counts > 0)
        t = np.where(new.all(1, keepdims=True), 0, t)  # nothing is left to escape to
        whole = np.maximum(n + t, 1)
        shorter = np.searchsorted(rows[depth - 1], rows[depth][row] & ((1 << 8 * (depth - 1)) - 1)) if depth else row
        return counts / whole + np.where(n > 0, t / whole, 1.0) * chances(depth - 1, shorter, new)

    logs = []
    for depth, known in enumerate(rows):
        for i in range(0, len(known), 2048):
            row = np.arange(i, min(i + 2048, len(known)))
            with np.errstate(divide="ignore"):
                logs.append(np.log10(chances(depth, row, np.zeros((len(row), 256), bool))).astype(np.float32))
    return {f"contexts{d}": k for d, k in enumerate(rows)} | {"logs": np.concatenate(logs)}


def row_of_context(table: dict[str, np.ndarray]) -> np.ndarray:
    """For every three bytes, as a number, their row, or -1."""
    base = sum(len(table[f"contexts{depth}"]) for depth in range(DEPTH))
    found = np.full(1 << 8 * DEPTH, -1, np.int32)
    found[table[f"contexts{DEPTH}"]] = np.arange(base, base + len(table[f"contexts{DEPTH}"]), dtype=np.int32)
    return found


def _ending(gram: Column | str, length: int) -> Column:
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << 8 * length) - 1))


def _before(gram: str) -> Column:
    return F.shiftright(gram, 8)


def _strings(grams: DataFrame) -> list[DataFrame]:
    """(gram, n) of the strings of 1 to 4 bytes."""
    return [grams.groupBy(_ending("gram", length).alias("gram")).agg(F.sum("n").alias("n")) for length in range(1, DEPTH + 1)] + [grams]


def frequent_strings(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The strings after the most frequent contexts, by length, as (numbers, counts): a context's are all there, and so are its endings'."""
    # Frequencies in steps of a sixteenth of a power of two. A context's ending is at least as frequent, so one bound for all lengths keeps it.
    step = F.floor(F.log2("total") * 16)
    nodes, bound = _strings(grams), 0
    for node in nodes[1:]:
        contexts = node.groupBy(_before("gram").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("strings"))
        n_contexts = n_strings = 0
        for r in contexts.groupBy(step.alias("step")).agg(F.count("*").alias("contexts"), F.sum("strings").alias("strings")).orderBy(F.desc("step")).collect():  # 1,024 rows at most
            n_contexts, n_strings = n_contexts + r["contexts"], n_strings + r["strings"]
            if n_contexts > CONTEXTS or n_strings > NODES:
                bound = max(bound, r["step"] + 1)
                break
    children = []
    for depth, node in enumerate(nodes):
        if depth:
            contexts = node.groupBy(_before("gram").alias("context")).agg(F.sum("n").alias("total")).where(step >= bound).select("context")
            node = node.join(contexts, _before("gram") == F.col("context"), "left_semi")
        kept = node.select("gram", "n").toArrow().sort_by("gram")  # 256 or NODES rows at most
        children.append((kept["gram"].to_numpy(), kept["n"].to_numpy()))
    return children


def chances(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, log): log10 of the chance of the last byte of each asked string of four bytes, from all counted strings (gram, n)."""
    nodes = _strings(grams)
    total, n_symbols = nodes[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    near = lambda table, length: F.broadcast(table) if length <= 2 else table  # 65,536 rows at most
    # Of each context: its bytes n and its symbols t, and how many bytes these symbols have after the context one shorter.
    known = [None]
    for depth in range(1, DEPTH + 1):
        shorter = nodes[depth - 1].select(F.col("gram").alias("s_gram"), F.col("n").alias("s_n"))
        both = nodes[depth].join(near(shorter, depth), _ending("gram", depth) == F.col("s_gram"))
        known.append(both.groupBy(_before("gram").alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("t"), F.sum("s_n").alias("x")))
    out = asked.select("gram")
    for depth, node in enumerate(nodes):
        node = node.select(F.col("gram").alias("own"), F.col("n").alias(f"k{depth}"))
        out = out.join(near(node, depth + 1), _ending("gram", depth + 1) == F.col("own"), "left").drop("own")
        if depth:
            table = known[depth].select("context", *[F.col(c).alias(f"{c}{depth}") for c in ("n", "t", "x")])
            out = out.join(near(table, depth), _ending(_before("gram"), depth) == F.col("context"), "left").drop("context")
    out = out.withColumns({"n0": F.lit(total), "t0": F.lit(n_symbols)})

    escaped = F.lit(1 / max(1, 256 - n_symbols))  # among the bytes that were never seen
    chance = F.when(F.col("k0").isNotNull(), F.col("k0") / F.lit(max(1, total + n_symbols % 256))).otherwise(F.lit((n_symbols % 256) / max(1, total + n_symbols % 256)) * escaped) if total else F.lit(1 / 256)
    for depth in range(1, DEPTH + 1):
        n, t, x, k = (F.col(f"{c}{depth}") for c in "ntxk")
        n_below, t_below, k_below = (F.col(f"{c}{depth - 1}") for c in "ntk")
        n_left, t_left = n_below - x, F.when(t_below == 256, 0).otherwise(t_below - t)
        # Escaped to the context one shorter, where the symbols of this one are out.
        escaped = F.when(k_below.isNotNull(), k_below / (n_left + t_left)).when(n_left > 0, t_left / (n_left + t_left) * escaped).otherwise(escaped)
        here = F.when(t == 256, 0).otherwise(t)
        chance = F.when(n.isNull(), chance).when(k.isNotNull(), k / (n + here)).otherwise(here / (n + here) * escaped)
    return out.select("gram", F.log10(chance).alias("log"))


def train(docs: DataFrame, text_column: str = "text") -> tuple[dict, DataFrame, DataFrame]:
    """The part of the model that is broadcast, of bounded size, the words too rare to be in it as (word, n), and all strings of four bytes as (gram, n)."""
    docs = docs.select(docs[text_column].alias("text"))
    counts = written(corpus_counts(docs), "lm-counts")
    grams, words = counts.where("gram is not null").select("gram", "n"), counts.where("word is not null").select("word", "n")
    table = ppm_table(frequent_strings(grams), 1)
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = docs.count()
    # The count from which on words are broadcast, so that there are KNOWN at most.
    by_count = words.groupBy(F.least(F.col("n"), F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # 65,536 rows at most
    so_far, least = 0, None
    for r in by_count:
        so_far += r["words"]
        if so_far > KNOWN:
            break
        least = r["n"]
    frequent = (F.col("n") >= F.lit(least if least is not None else 1 << 62)) & (F.length("word") <= KNOWN_BYTES)
    known = words.where(frequent).toArrow()  # KNOWN rows at most
    model = {"table": table, "words": known["word"].combine_chunks(), "counts": known["n"].to_numpy(), "N": n_words + n_docs, "V": n_distinct + bool(n_docs), "end": n_docs}
    return model, words.where(~frequent), grams


def score(docs: DataFrame, model: dict, rare: DataFrame, grams: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    below = float(model["N"] + 0.1 * (model["V"] + 1))
    kind = dict(docs.dtypes)[id_column]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        row, logs = row_of_context(own["table"]), own["table"]["logs"].ravel()
        known = dict(zip(own["words"].to_pylist(), np.log10((own["counts"] + 0.1) / below).tolist(), strict=True))
        end = float(np.log10((own["end"] + 0.1) / below))
        for part in slices(rows, "text", 2 << 20):
            context, symbol, length = positions(part.column("text"))
            place = row[context].astype(np.int64)
            each = np.where(place >= 0, logs[place * 256 + symbol], 0).astype(np.float64)
            # The strings of other contexts, counted by text.
            at = np.flatnonzero(place < 0)
            pairs = (np.searchsorted(np.cumsum(length), at, "right").astype(np.uint64) << np.uint64(32)) | ((context[at] << np.uint32(8)) | symbol[at]).astype(np.uint64)
            pairs, times = np.unique(pairs, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(length) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)
            strings = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times.astype(np.int64))], ["gram", "tf"]))
            total, full = np.zeros(len(length)), length > 0
            if full.any():
                total[full] = np.add.reduceat(each, (np.cumsum(length) - length)[full])
            n, n_known, base, others = [], [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                found = [known.get(w) for w in words]
                missed = [w for w, x in zip(words, found, strict=True) if x is None] if None in found else []
                n.append(len(words) + 1)
                n_known.append(len(words) - len(missed) + bool(own["end"]))
                base.append(sum(sorted(x for x in found if x is not None)) + end)
                others.append(list(Counter(missed).items()))
            word = pa.array([[{"word": w, "tf": k} for w, k in x] for x in others], pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))
            arrays = [part.column("id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), word, strings]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "n_tokens", "n_known", "base", "score", "others", "strings"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, others array<struct<word: binary, tf: long>>, strings array<struct<gram: long, tf: long>>"
    scored = docs.select(docs[id_column].alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs[text_column].cast("string").alias("text")).mapInArrow(run, schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    unseen = F.log10(F.lit(0.1 / below))
    others = scored.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.tf")
    met = others.join(rare, "word").select("row", F.col("tf").alias("n_known"), (F.col("tf") * (F.log10((F.col("n") + 0.1) / F.lit(below)) - unseen)).alias("base"))
    strings = scored.select("row", F.explode("strings").alias("s")).select("row", "s.gram", "s.tf")
    logs = written(chances(strings.select("gram").distinct(), grams), "lm-chances")
    found = strings.join(logs, "gram").select("row", (F.col("tf") * F.col("log")).alias("score"))
    missed = F.aggregate("others", F.lit(0).cast("long"), lambda a, x: a + x["tf"])
    own = scored.select("row", "id", "held_out", "n_tokens", "n_known", (F.col("base") + missed * unseen).alias("base"), "score")
    both = own.unionByName(met, allowMissingColumns=True).unionByName(found, allowMissingColumns=True).groupBy("row")
    out = both.agg(F.max("id").alias(id_column), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select(id_column, "held_out", "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Train on the rows that are not held out, score all."""
    model, rare, grams = train(docs.where(~F.coalesce(held_out, F.lit(False))), text_column)
    return score(docs, model, rare, grams, held_out, id_column, text_column)
