"""Decontamination, hard negatives and collocations against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import collocations, decontamination, negatives, queries

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, id long, digest string, spans int, items string, words string, n int, phrase string, total int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _rows():
    rng = random.Random(5)
    words = ["a", "B", "c", "De", "é", "日本", "x1"]
    sentence = lambda n: rng.choice([" ", ", ", ". ", "\n", "  ", "\t"]).join(rng.choice(words) for _ in range(n))
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 30])))) for i in range(30)]
    items = [x for x in items if len(x[1].split()) > 3] + [("s1", "zeta eta"), ("s1", "other words"), ("dup", "zeta eta"), (None, "null id item"), ("null", None), ("empty", " ... "), ("long", " ".join(rng.choice(words) for _ in range(9000)))]
    docs = [(None, "zeta ETA!", "en"), (1, None, "de"), (2, "", None), (3, ".,;", "de"), (4, "null, id. item", None), (5, "zeta", "en"), (6, "zeta.eta.zeta-eta", "en")]
    for i in range(10, 60):
        text = sentence(rng.randint(0, 40))
        if i % 3 == 0:
            text += " " + rng.choice(items[:-4])[1].upper() + rng.choice([" ", "."]) + sentence(rng.randint(0, 8))
        docs.append((i, text, rng.choice(["en", "de", None])))
    docs += [docs[20], docs[20], (70, sentence(60_000), "en"), (71, items[-1][1][500:3000], "de"), (72, "zzz " * 3 + items[-1][1][:200] + " zzz", "de")]
    return docs, items


DOCS, ITEMS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z", 3, "p", 4) for r in DOCS], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id string, text string, size int, spans int").repartition(3)


def hits_of(text):
    words, hit, ids = LETTERS.findall(lowered(text)), set(), set()
    for item, item_text in ITEMS:
        own = LETTERS.findall(lowered(item_text))
        n = min(len(own), 10)
        of_item = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in of_item:
                hit |= set(range(i, i + n))
                ids |= {item} - {None}
    return words, hit, ids


@pytest.mark.parametrize("shard_bytes", [2 << 20, 9000])
def test_decontamination(docs, items, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(decontamination, "PIECE", 4096 if shard_bytes > 9000 else 50)
    monkeypatch.setattr(decontamination, "CHUNK", 1 << 20 if shard_bytes > 9000 else 64)
    got = Counter((r["doc_id"], r["n_words"], sum(s["words"] for s in r["spans"]), tuple((s["start"], s["words"]) for s in r["spans"]), tuple(r["items"]), r["kept"]) for r in decontamination.decontaminate(docs, items).collect())
    want = Counter()
    for doc_id, text, _ in DOCS:
        words, hit, ids = hits_of(text)
        spans = [(i, next(j for j in range(i, len(words) + 1) if j not in hit) - i) for i in sorted(hit) if i - 1 not in hit]
        kept = text
        if spans:
            places = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
            for start, n in reversed(spans):
                kept = kept[: places[start][0]] + kept[places[start + n - 1][1] :]
            kept = "" if len(hit) > 0.8 * len(words) else kept
        want[doc_id, len(words), len(hit), tuple(spans), tuple(sorted(ids)), kept] += 1
    assert got == want


def test_longest_match(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x y")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "q b c d e f g h i j k l q x y q"), (2, "b c d e f g h i j q")], "doc_id int, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: [(1, 11, 11), (13, 2, 2)], 2: []}


def test_empty_inputs(spark, docs, items):
    no_docs, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id string, text string")
    assert decontamination.decontaminate(no_docs, items).count() == 0
    assert decontamination.decontaminate(docs, no_items).where("size(spans) > 0 or size(items) > 0").count() == 0
    assert collocations.collocations(no_docs).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.lit(True)).count() == 0


def test_items_digest(spark, tmp_path):
    spark.createDataFrame([(r[0], r[1]) for r in DOCS], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in queries.op11_suffix_automaton(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = Counter()
    for doc_id, text, _ in DOCS:
        words, hit, ids = hits_of(text)
        want[doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert got == want


def _negatives(rows, is_anchor, n_positives, n_negatives):
    usable = [(i, lab, np.floor(np.array(v, float) * 256).astype(object)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    usable = [(i, lab, [int(x) for x in v]) for i, lab, v in usable]
    out = Counter()
    for a in {i for i, _, _ in usable if is_anchor(i)}:
        _, label, vector = min((lab, v) for i, lab, v in usable if i == a) and min((u for u in usable if u[0] == a), key=lambda u: (u[1], u[2]))
        scored = sorted(((-sum(x * y for x, y in zip(vector, v, strict=True)), i, lab) for i, lab, v in usable if i != a and len(v) == len(vector)), key=lambda x: x[:2])
        for score, positive, _ in [x for x in scored if x[2] == label][:n_positives]:
            fit = [x for x in scored if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:n_negatives]
            for rank, (s, i, _) in enumerate(fit, 1):
                out[a, positive, rank, i, -score, -s] += 1
    return out


@pytest.mark.parametrize("a_pass", [2048, 7])
def test_hard_negatives(spark, monkeypatch, a_pass):
    monkeypatch.setattr(negatives, "ANCHORS_A_PASS", a_pass)
    monkeypatch.setattr(negatives, "ROWS_A_BLOCK", 100)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((3, 9))
    rows = [(i, int(i % 3), [float(x) for x in (centres[i % 3] + 2 * rng.standard_normal(9)).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, i % 4, rows[10][2]) for i in range(150)]  # one vector many times
    rows += [rows[40], rows[41], (5000, None, rows[0][2]), (5100, 1, None), (5200, 1, [float("nan")] * 9), (5300, 1, [None] * 9), (5400, 1, [float("inf")] + [0.0] * 8), (None, 1, rows[1][2]), (6000, 1, [1.0, 2.0]), (6001, 1, [2.0, 2.0]), (6002, 2, [1.0, 0.5]), (7000, 0, [0.0] * 9), (8000, 3, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, n int, anchor string").repartition(3)
    got = Counter(tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % 20 == 0).collect())
    want = _negatives(rows, lambda i: i % 20 == 0, 5, 10)
    assert got == want and len(want) > 500


def test_negatives_of_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in rng.integers(-9, 9, 3) * 1e5]) for i in range(60)] + [(100 + i, i % 2, [float(x) * 1e8 for x in rng.integers(1, 9, 3)]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, scale=1).collect()) == _negatives([(i, lab, [x / 256 for x in v]) for i, lab, v in rows], lambda i: i % 5 == 0, 5, 10)


def test_vector_file_bounds():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.standard_normal((300, 7)) * 256)
    block = negatives.Block(negatives.packed(np.arange(300), np.zeros(300, np.int64), vectors))
    anchors = np.floor(rng.standard_normal((5, 7)) * 256)
    low, high = block.bounds(anchors, slice(0, 300))
    exact = block.vectors @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.5 * (exact.max() - exact.min())  # they tell rows apart


def _collocations(rows, least, top, max_n=5):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, max_n + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_collocations(docs, monkeypatch, broadcast):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", broadcast)
    got = Counter(tuple(r) for r in collocations.collocations(docs, least=4, top=300).collect())
    want = _collocations(DOCS, 4, 300)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("max_n", [2, 3])
def test_shorter_phrases(docs, max_n):
    got = Counter(tuple(r) for r in collocations.collocations(docs, least=2, top=50, max_n=max_n).collect())
    assert got == _collocations(DOCS, 2, 50, max_n)


def test_exact_scores(spark):
    """Counts whose products pass 64 bits, through the expression that scores them."""
    numbers = {"a": 10**15 + 3, "n": 9 * 10**15 + 7, "l": 10**15 + 9, "r": 2 * 10**15 + 1}
    exact = {c: f"cast({v} as decimal(18, 0))" for c, v in numbers.items()}
    assert spark.range(1).select(F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")).first()[0] == 1000 * numbers["a"] * numbers["n"] // (numbers["l"] * numbers["r"])
