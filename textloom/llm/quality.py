"""A quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters look at WIDTH bytes every STEP bytes. A
document is covered by chunks of 2 * HALF bytes that overlap by HALF: in each chunk every
filter's largest answer counts, the chunks' answers are averaged over
the whole document, and a logistic unit makes one probability of them.

It is fitted on the driver, on a bounded sample of labelled rows: the first by a digest of their ids, at most ``per_class`` rows and TRAIN_BYTES of whole texts
of either label. Only the text is an input. Scoring is one pass over whole texts, PIECE chunks at a time, so that a text of any length takes bounded memory.

A null text is empty, and gets the score of zero bytes. Labels other than 0 and 1 and labels without a document are left out; of several labels of
a document the smallest counts. Without both labels every score is 0.5. Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import raw, slices

WIDTH, STEP, HALF = 8, 4, 128
EMBEDDING, FILTERS = 6, 24
PER_CLASS, TRAIN_BYTES = 800, 16 << 20
#: Halves of chunks that are answered at a time.
PIECE = 2048
EPOCHS, BATCH, RATE = 10, 16, 0.01


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed).standard_normal
    shapes = {"embedding": (256, EMBEDDING), "filters": (WIDTH * EMBEDDING, FILTERS), "bias": (FILTERS,), "out": (FILTERS,), "level": (1,)}
    scale = {"embedding": 0.5, "filters": (WIDTH * EMBEDDING) ** -0.5, "bias": 0, "out": 0.3, "level": 0}
    return {k: (draw(s) * scale[k]).astype(np.float32) for k, s in shapes.items()}


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes with zeros up to whole halves of chunks, and the number of halves of each."""
    length = np.diff(offsets)
    halves = -(-(length + WIDTH - STEP) // HALF)
    end = np.cumsum(halves)
    padded = np.zeros(int(end[-1]) * HALF + WIDTH, np.uint8)
    for at, a, b in zip(((end - halves) * HALF).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        padded[at : at + b - a] = data[a:b]
    return padded, halves


def _answers(weights: dict, padded: np.ndarray, halves: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, inputs, answers): what the filters see and say at the places of the halves from ``first`` up to ``last``."""
    at = np.arange(first * HALF // STEP, last * HALF // STEP) * STEP
    windows = padded[at[:, None] + np.arange(WIDTH)]
    end = np.cumsum(halves)
    end = end[(end > first) & (end <= last)] - first
    windows[end * (HALF // STEP) - 1, WIDTH - STEP :] = 0  # the next document begins there
    inputs = weights["embedding"][windows].reshape(len(windows), -1)
    return windows, inputs, (inputs @ weights["filters"]).reshape(-1, HALF // STEP, FILTERS)


def _pooled(weights: dict, best: np.ndarray, halves: np.ndarray) -> dict:
    """From each half's largest answers to a logit a document, with what training needs."""
    # The chunks: each half with its next one, or alone in a document of one half.
    end = np.cumsum(halves)
    last = np.zeros(len(best), bool)
    last[end - 1] = True
    starts = ~last
    starts[end[halves == 1] - 1] = True
    first = np.flatnonzero(starts)
    second = np.where(last[first], first, first + 1)
    later = best[second] > best[first]
    chunk = np.maximum(np.where(later, best[second], best[first]), 0)
    n_chunks = np.maximum(halves - 1, 1)
    pooled = np.add.reduceat(chunk, np.cumsum(n_chunks) - n_chunks) / n_chunks[:, None]
    return {"first": first, "second": second, "later": later, "chunk": chunk, "n_chunks": n_chunks, "pooled": pooled, "logit": pooled @ weights["out"] + weights["level"]}


def _forward(weights: dict, data: np.ndarray, offsets: np.ndarray) -> dict:
    """All that the network makes of the documents, with what its training needs."""
    padded, halves = _padded(data, offsets)
    windows, inputs, answers = _answers(weights, padded, halves, 0, int(halves.sum()))
    best = answers.max(1) + weights["bias"]
    return {"windows": windows, "inputs": inputs, "answers": answers, "best": best} | _pooled(weights, best, halves)


def probabilities(weights: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A probability for each document; the documents' bytes stand one after another."""
    padded, halves = _padded(data, offsets)
    n = int(halves.sum())
    best = np.concatenate([_answers(weights, padded, halves, i, min(n, i + PIECE))[2].max(1) for i in range(0, n, PIECE)]) + weights["bias"]
    return 1 / (1 + np.exp(-_pooled(weights, best, halves)["logit"].astype(np.float64)))


def _gradients(weights: dict, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, importance: np.ndarray) -> dict:
    f = _forward(weights, data, offsets)
    error = ((1 / (1 + np.exp(-f["logit"])) - label) * importance / importance.sum()).astype(np.float32)
    d_chunk = np.repeat(error[:, None] * weights["out"] / f["n_chunks"][:, None].astype(np.float32), f["n_chunks"], axis=0) * (f["chunk"] > 0)
    d_best = np.zeros_like(f["best"])
    np.add.at(d_best, f["first"], np.where(f["later"], 0, d_chunk))
    np.add.at(d_best, f["second"], np.where(f["later"], d_chunk, 0))
    position = f["answers"].argmax(1) + np.arange(len(d_best))[:, None] * (HALF // STEP)
    filters = weights["filters"].T.reshape(FILTERS, WIDTH, EMBEDDING)
    d_filters = np.einsum("hf,hfk->kf", d_best, f["inputs"][position], optimize=True)
    d_embedding = np.zeros_like(weights["embedding"])
    np.add.at(d_embedding, f["windows"][position], d_best[:, :, None, None] * filters)
    return {"embedding": d_embedding, "filters": d_filters, "bias": d_best.sum(0), "out": f["pooled"].T @ error, "level": error.sum(keepdims=True)}


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Weights by Adam; both labels count alike in sum. None if one label is missing."""
    labels = np.asarray(labels, np.float32)
    if not 0 < labels.sum() < len(labels):
        return None
    weights, rng = fresh_weights(seed), np.random.default_rng(seed)
    mean, square, t = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2)), None, 0
    mean, square = mean
    importance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            data = np.frombuffer(b"".join(texts[j] for j in own), np.uint8)
            offsets = np.cumsum([0, *(len(texts[j]) for j in own)])
            t += 1
            for k, g in _gradients(weights, data, offsets, labels[own], importance[own]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                weights[k] = (weights[k] - RATE * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return weights


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, label: str, id_column: str, text_column: str, per_class: int) -> DataFrame:
    """(id, label, text, digest) of the bounded sample. allowed: a condition on the id column of ``labels``.

    Labels are joined with the documents' ids first, so that only such with a document count; then the chosen ones with their texts.
    """
    own = labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.min(label).alias("label"))
    own = own.join(docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id")), "id", "left_semi").withColumn("digest", F.md5(F.col("id").cast("string")))
    few = [own.where(F.col("label") == k).orderBy("digest", "id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(few[0].unionByName(few[1]))  # 2 * per_class rows at most
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null").join(few, "id").select("id", "label", "text", "digest")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", id_column: str = "doc_id", text_column: str = "text", per_class: int = PER_CLASS) -> dict[str, np.ndarray] | None:
    """Weights from the labelled documents for which ``allowed`` holds."""
    rows = training_rows(docs, labels, allowed, label, id_column, text_column, per_class)
    texts, y = [], []
    for k in (0, 1):
        left = TRAIN_BYTES
        for r in rows.where(F.col("label") == k).orderBy("digest", "id", "text").limit(per_class).select("text").toLocalIterator():
            text = r["text"].encode()
            if len(text) <= left:
                left -= len(text)
                texts.append(text)
                y.append(k)
    return fit(texts, np.array(y))


def quality_scores(docs: DataFrame, weights: dict[str, np.ndarray] | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the column quality_score, the probability of label 1, rounded to six digits; one of that name is replaced."""
    docs = docs.drop("quality_score")
    own = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column, 256 << 10):
            score = np.full(part.num_rows, 0.5) if own.value is None else probabilities(own.value, *raw(part.column(text_column)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(score, 6))], [*part.schema.names, "quality_score"])

    schema = docs.select("*", F.lit(0.0).alias("quality_score")).schema
    return docs.mapInArrow(run, schema)
