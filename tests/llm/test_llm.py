"""Every operator against a plain version of its contract, on texts with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, fm_dedup, licenses, lm, media, minhash, mixing, quality, segments, suffix_dedup
from textloom.llm.components import connected

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, id long, n long, route long, label string, kept boolean, mix_size long, quality_score string"


def _texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["é", "日本", "MIT", "License", "Apache", "naïve"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    base = [rng.choice(words) for _ in range(150)]
    rows = [(None, "null id, " + passage, "a"), (2, None, "b"), (3, "", None), (4, "   \n\t", "a"), (5, "one", "b"), (6, "one two", "b"), (7, "one two", "b")]
    for i in range(10, 40):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            own[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(own), rng.choice("abc")))
    for i in range(40, 60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + " " + passage + "\n" + rng.choice(words), rng.choice("abc")))
    rows += [rows[12], rows[12], (70, "ab " * 400, "c"), (71, "x" * 5000, "c"), (72, "Released under the MIT License. " * 2 + "mit license", "a"), (73, "Licensed under the apache license, version 2.0", None), (74, "The GENERAL public\nLICENSE: general public license", "a")]
    rows += [(75, " ".join(rng.choice(words) for _ in range(30_000)), "c")]
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", True, 9, "q") for r in ROWS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_empty_tables(spark, empty, ranks):
    assert bpe.bpe_digests(empty, *ranks).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert fm_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    assert licenses.license_scan(empty).count() == 0
    assert media.avi_digests(empty).count() == 0
    assert media.avi_clips(media.store_avi(empty)).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert lm.lm_scores(empty, F.lit(False)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(empty, quality.train(empty, labels, F.lit(True))).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 16)).astype(np.float32)
    vectors[50:60] = vectors[49]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0]), (405, []), (None, [1.0] * 16), (406, [float("inf")] * 16)]
    table = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "vec_id long, embedding array<float>, score double, rank int").repartition(3)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        exact = sorted(((-float(vectors[q].astype(float) @ vectors[i].astype(float)), i) for i in range(300) if i != q))[:20]
        assert sorted(found) == list(range(1, 21))
        hits += len({i for _, i in exact} & {v for v, _ in found.values()})
        for v, s in found.values():
            assert s == pytest.approx(float(vectors[q].astype(float) @ vectors[v].astype(float)))
        assert [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
    assert hits >= 0.95 * 20 * len(got)


def test_neighbours_of_tiny_and_huge_vectors(spark):
    """Squares of components vanish or overflow; the measure on the vectors themselves does not."""
    rows = [(0, [1.0, 0.0]), (1, [1e-3, 0.0]), (2, [1e200, 1.0]), (3, [1e-200, 1e-200]), (4, [-1.0, 0.0]), (5, [-1e200, 0.0]), (20, [1e-200, 0.0]), (40, [1e100, 1e100])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, vector in rows:
        if q % 20 == 0:
            exact = sorted(((sum(x * y for x, y in zip(vector, v, strict=True)), i) for i, v in rows if i != q), key=lambda x: (-x[0], x[1]))[:4]
            assert got[q] == [(i, s) for s, i in exact]


def test_neighbours_of_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]


def _shingles(text: str | None, k: int) -> set:
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize(("k", "threshold"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(docs, k, threshold):
    sets = {(i, t): _shingles(t, k) for i, t, _ in ROWS}
    ids = {i for i, _ in sets if i is not None}
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = [key for key in sets if key[0] is not None]
    for a in keys:
        for b in keys:
            both = len(sets[a] & sets[b])
            if a[0] < b[0] and both and threshold[1] * both >= threshold[0] * len(sets[a] | sets[b]):
                x, y = sorted((find(a[0]), find(b[0])))
                group[y] = x
    expected = Counter((i, len(sets[i, t]), None if i is None else find(i), i is None or i == find(i)) for i, t, _ in ROWS)
    assert multiset(minhash.near_duplicates(docs, k, threshold), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Documents that all look alike to the sketch, of which few are linked."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SKETCHES", 16)
    rng = random.Random(5)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(120), 5):
            own[j] = f"x{i}-{j}"
        rows.append((i, " ".join(own)))
    sets = [_shingles(t, 3) for _, t in rows]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 78 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (78, 100))
    assert dict(multiset(got, "doc_id", "component_id").keys()) == dict(enumerate(group))


def test_register_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    r = minhash.registers([np.unique(a), np.unique(b), np.unique(a[:3])])
    n = np.array([4000.0])
    assert abs(minhash.estimate(r[:1], r[1:2], n, n)[0] - 3600 / 4400) < 0.2
    assert len(set(r[2])) <= 3


def test_register_estimates_of_blocks():
    rng = np.random.default_rng(8)
    a, b, n = rng.integers(0, 3, (9, minhash.BUCKETS)).astype(np.uint16), rng.integers(0, 3, (5, minhash.BUCKETS)).astype(np.uint16), rng.integers(1, 500, 14).astype(float)
    table = minhash.estimates(a, b, n[:9], n[9:])
    for i in range(9):
        for j in range(5):
            assert table[i, j] == pytest.approx(minhash.estimate(a[i : i + 1], b[j : j + 1], n[i : i + 1], n[9 + j : 10 + j])[0], abs=1e-5)


def test_pairings_meet_all_pairs_of_different_roots():
    rng = np.random.default_rng(10)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        roots, side = rng.integers(0, 3, n), rng.integers(0, 2, n)
        met = {frozenset((int(i), int(j))) for some, others in minhash.pairings(roots, side) for i in some for j in others if roots[i] != roots[j]}
        crossing = len(set(side.tolist())) == 2
        assert met == {frozenset((i, j)) for i in range(n) for j in range(i) if roots[i] != roots[j] and (not crossing or side[i] != side[j])}
        sets = [np.unique(rng.integers(0, 30, 8).astype(np.uint64)) for _ in range(n)]
        for some, others in minhash.pairings(roots, side):
            assert minhash.common_elements(sets, some, others).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in others] for i in some]


def test_stars_connect_what_the_links_connect():
    rng = np.random.default_rng(9)
    for _ in range(100):
        good = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        rows = len(good)

        def components(edges):
            group = list(range(sum(good.shape)))
            for x, y in edges:
                group = [group[y] if g == group[x] else g for g in group]
            return {frozenset(i for i, g in enumerate(group) if g == k) for k in set(group)}

        assert components(minhash.stars_of(good)) == components([(i, rows + j) for i, j in np.argwhere(good).tolist()])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(9, 9), (5, None)]
    group = {}
    for a, b in edges:
        if b is not None and a != b:
            group.setdefault(a, a)
            group.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if b is not None and a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["root"]) for r in got.collect()} == set(group.items())


def test_quality_network(spark):
    rng = random.Random(1)
    clean = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choice("ABC!$%|") for _ in range(5)) for _ in range(60))
    rows = [(i, clean() if i % 3 else junk(), "x") for i in range(240)] + [(900, None, "x"), (901, "", "x"), (900, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, None), (7, 4), (None, 1), (12345, 0)], "doc_id long, quality int")
    weights = quality.train(table, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    out = {}
    for r in quality.quality_scores(table, weights).collect():
        assert 0 <= r["quality_score"] <= 1
        assert out.setdefault(r["doc_id"], r["quality_score"]) == r["quality_score"]
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.5) == (i % 3 > 0) for i in held) >= 0.95 * len(held)


def test_network_against_plain_loops(monkeypatch):
    """Byte by byte, filter by filter: chunks of 256 bytes every 128 cover the whole text, with zeros after it."""
    weights = quality.fresh_weights(3)
    rng = random.Random(2)
    texts = [b"", b"a", rng.randbytes(120), rng.randbytes(128), rng.randbytes(129), rng.randbytes(1000), rng.randbytes(5000)]

    def plain(text: bytes) -> float:
        halves = -(-(len(text) + 4) // 128)
        data = text + bytes(halves * 128 + 8 - len(text))
        answer = lambda p, f: sum(float(weights["embedding"][data[p + i]][e]) * float(weights["filters"][i * 6 + e][f]) for i in range(8) for e in range(6))
        best = [[max(answer(h * 128 + p, f) for p in range(0, 128, 4)) + float(weights["bias"][f]) for f in range(24)] for h in range(halves)]
        chunks = [best[h : h + 2] for h in range(max(1, halves - 1))]
        pooled = [sum(max(0.0, *(half[f] for half in c)) for c in chunks) / len(chunks) for f in range(24)]
        return 1 / (1 + math.exp(-(sum(p * float(w) for p, w in zip(pooled, weights["out"], strict=True)) + float(weights["level"][0]))))

    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for piece in (2048, 3):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert quality.probabilities(weights, data, offsets) == pytest.approx([plain(t) for t in texts], abs=1e-5)


def test_training_rows_are_bounded(spark, monkeypatch):
    """Labels without a document don't take the place of others; texts count whole up to the bound."""
    rows = [(i, "x" * (10 + i)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1000 + i, 1) for i in range(500)] + [(99, 1)], "doc_id long, quality int")
    found = quality.training_rows(docs, labels, F.lit(True), "quality", "doc_id", "text", 10).collect()
    first = lambda k: sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(40) if i % 2 == k)[:10]
    assert sorted((r["digest"], r["id"]) for r in found) == sorted(first(0) + first(1))
    taken = {}
    monkeypatch.setattr(quality, "fit", lambda texts, y: taken.update(sizes=[len(t) for t in texts], y=y.tolist()))
    monkeypatch.setattr(quality, "TRAIN_BYTES", 100)
    quality.train(docs, labels, F.lit(True), per_class=10)
    assert set(taken["y"]) == {0, 1} and all(sum(s for s, k in zip(taken["sizes"], taken["y"], strict=True) if k == c) <= 100 for c in (0, 1))


def test_gradients():
    weights = {k: v.astype(np.float64) for k, v in quality.fresh_weights().items()}
    data, offsets = np.frombuffer(b"some text and more!" * 30 + b"short", np.uint8), np.array([0, 570, 570, 575])
    label, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss = lambda w: float(np.mean(np.log1p(np.exp(-(2 * label - 1) * quality._forward(w, data, offsets)["logit"]))))
    gradients = quality._gradients(weights, data, offsets, label, weight)
    for name, at in (("out", (3,)), ("bias", (2,)), ("filters", (5, 1)), ("embedding", (ord("e"), 2)), ("level", (0,))):
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert gradients[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)


def test_media_round_trip(docs):
    for r in media.avi_digests(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        data = (r["text"] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    clips = media.avi_clips(media.store_avi(docs.where("doc_id = 75"))).orderBy("clip").collect()
    assert clips[0]["first_frame"] == 0 and all(a["last_frame"] + 1 == b["first_frame"] and a["end_s"] == b["start_s"] for a, b in zip(clips, clips[1:], strict=False))


def test_media_of_any_bytes():
    rng = random.Random(4)
    for payload in (rng.randbytes(6400), b"\xff" * 64, bytes(range(256)) * 100, b"\0" * 128):
        data = media.encode_avi(payload)
        assert media.decode_avi(data)[0] == payload
        places = media.read_riff(data)["frames"]
        at, size = places[0]
        frame = data[at : at + size]
        assert (media._blocks_bit_by_bit(frame, media.parse_jpeg(frame)) == media.decode_frames(data, places[:1])[0][0]).all()
    with pytest.raises(ValueError):
        media.read_riff(b"RIFFxxxxWAVE" + b"\0" * 20)


def test_media_that_cannot_be_read(spark):
    whole = media.encode_avi(bytes(range(256)) * 10)
    broken = bytearray(whole)
    broken[whole.index(b"\xff\xda") + 20] ^= 0xFF
    rows = [(1, whole), (2, b""), (3, b"no media"), (4, whole[: len(whole) // 2]), (5, bytes(broken)), (6, None)]
    got: dict = {}
    for r in media.avi_clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert all(r["error"] is None for r in got[1]) and all(len(got[i]) == 1 and got[i][0]["error"] and got[i][0]["clip"] is None for i in (2, 3, 4, 5))


def test_shots_follow_histograms():
    a, b = np.eye(media.BINS)[0], np.eye(media.BINS)[5]
    assert media.shot_starts(np.array([a] * 6 + [b] * 6 + [a] * 3)) == [0, 6, 12]
    assert media.shot_starts(np.zeros((0, media.BINS))) == []


def _without_repeats(words: bool, length: int, unique_rows: list[tuple], other_documents: bool) -> dict:
    split = (lambda t: WORD.findall(t)) if words else (lambda t: t)
    units = {(i, t): split((t or "").encode()) for i, t, _ in unique_rows}
    first, times = {}, Counter()
    for (i, _), u in units.items():
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length]) if words else u[p : p + length]
            times[w] += 1
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = {}
    for key, u in units.items():
        gone = bytearray(len(u))
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length]) if words else u[p : p + length]
            if (key[0] is not None and first.get(w, key[0]) < key[0]) if other_documents else times[w] > 1:
                gone[p : p + length] = b"\1" * length
        left = [x for x, g in zip(u, gone, strict=True) if not g]
        kept = b" ".join(left) if words else bytes(left)
        spans = sum(1 for p in range(len(u)) if gone[p] and not (p and gone[p - 1]))
        out[key] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(docs, monkeypatch, hot):
    if hot:  # every minimiser of several segments is split
        monkeypatch.setattr(segments, "BYTES_A_ROUTE", 1)
    expected = _without_repeats(True, 50, list(dict.fromkeys(ROWS)), True)
    want = Counter((i, *(expected[i, t][k] for k in (0, 1, 3))) for i, t, _ in ROWS)
    assert multiset(fm_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(segments, "BYTES_A_ROUTE", 1)
        monkeypatch.setattr(segments, "MOST_BROADCAST", -1)  # the way by joins
    expected = _without_repeats(False, 200, list(dict.fromkeys(ROWS)), False)
    want = Counter((i, *expected[i, t]) for i, t, _ in ROWS)
    assert multiset(suffix_dedup.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def _segment_answers(contents, documents, lasts, times, length, other):
    windows: dict = {}
    for c, d, k in zip(contents, documents, times, strict=True):
        for p in range(len(c) - length + 1):
            windows.setdefault(c[p : p + length], []).extend([d] * k)
    top = {}
    for c, d in zip(contents, lasts, strict=True):
        top[c] = max(top.get(c, d), d)
    smaller = lambda c, least: least if least < top[c] else None
    return [[smaller(c, min(windows[c[p : p + length]])) if other else len(windows[c[p : p + length]]) > 1 for p in range(len(c) - length + 1)] for c in contents]


def test_indexes_on_random_segments():
    rng = random.Random(6)
    for _ in range(40):
        length = rng.choice([8, 12, 50])
        alphabet = rng.choice(["ab", "abcdef"])
        base = "".join(rng.choice(alphabet) for _ in range(200))
        contents = []
        for _ in range(rng.randint(1, 7)):
            a = rng.randint(0, 120)
            own = list(base[a : a + rng.randint(length, length + 80)])
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(alphabet)
            if len(own) >= length:
                contents += ["".join(own)] * rng.choice([1, 1, 2])
        documents, times = [rng.randint(1, 9) for _ in contents], [rng.choice([1, 1, 2]) for _ in contents]
        lasts = [d + rng.choice([0, 0, 3]) for d in documents]
        if not contents:
            continue
        words = fm_dedup.repeated_windows([" ".join(c).encode() for c in contents], documents, lasts, times, length, 4 if length < 50 else 5)
        least = [{p: m for a, b, m in spans for p in range(a, b)} for spans in words]
        assert [[own.get(p) for p in range(len(c) - length + 1)] for own, c in zip(least, contents, strict=True)] == _segment_answers(contents, documents, lasts, times, length, True)
        spans = suffix_dedup.repeated_windows([c.encode() for c in contents], documents, lasts, times, length)
        flags = [[any(a <= p < b for a, b, _ in s) for p in range(len(c) - length + 1)] for c, s in zip(contents, spans, strict=True)]
        assert flags == _segment_answers(contents, documents, lasts, times, length, False)


def _license_row(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, found = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        found |= {label} if at else set()
    best = 0.0
    for label, template in licenses.TEMPLATES.items():
        half = licenses.half_block(template)
        own = set(re.findall(r"[a-z0-9]+", template.lower()))
        for b in range(0, max(1, len(words)), half):
            share = len(own & set(words[b : b + 2 * half])) / len(own)
            if share * len(own) >= math.ceil(licenses.THRESHOLD * len(own) - 1e-9):
                best = max(best, share)
                found.add(label)
    base = sorted(x for x in found if x in licenses.PHRASES.values())
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(found)), round(best, 9)


def test_license_scan(docs):
    got = licenses.license_scan(docs)
    expected = Counter((i, *_license_row(t)) for i, t, _ in ROWS)
    assert multiset(got.withColumn("score", F.round("score", 9)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == expected
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_templates_in_wider_text(spark):
    notice = "permission is granted free of charge to any person who is obtaining a copy of this software hereby"
    rows = [(1, "word " * 40 + notice + " word" * 9), (2, "mit License MIT license mit license"), (3, notice.replace("person", "one").replace("charge", "cost").replace("copy", "x").replace("software", "y"))]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for i in got} == {i: _license_row(t)[:6] for i, t in rows}
    assert got[1]["labels"] == "mit-grant" and got[1]["blocks"][0]["label"] == "mit-grant" and got[2]["n_base"] == 3


def test_license_texts_of_any_length(spark):
    """Whole texts, with a few words changed, anywhere in others; and templates given by the caller."""
    rng = random.Random(3)
    rows = []
    for i, (label, template) in enumerate(licenses.TEMPLATES.items()):
        own = template.split()
        for k in rng.sample(range(len(own)), len(own) // 25):
            own[k] = "changed"
        rows.append((i, "w " * rng.randrange(700) + " ".join(own) + " w" * rng.randrange(100)))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES.items()):
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == _license_row(rows[i][1])[:6]
        assert label in got[i]["labels"].split(",") and all(b["word"] >= 0 for b in got[i]["blocks"])
    long = " ".join(f"term{i}" for i in range(3000))
    table = spark.createDataFrame([(1, "x " * 999 + long), (2, " ".join(long.split()[:2000])), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.license_scan(table, {"own": long}, {"no such": "none"}).collect()} == {1: "own", 2: "", 3: ""}


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def test_bpe(docs, ranks):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=bpe.read_ranks(ranks[0]), special_tokens={})
    got = bpe.bpe_digests(docs, *ranks)
    expected = Counter()
    for i, t, _ in ROWS:
        ids = encoding.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert multiset(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    row = bpe.with_token_ids(docs.where("doc_id = 73"), *ranks).first()
    assert row["token_ids"] == encoding.encode_ordinary(ROWS[[r[0] for r in ROWS].index(73)][1]) and row["source"] is None


def test_bpe_of_odd_texts(ranks):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=bpe.read_ranks(ranks[0]), special_tokens={})
    codec = bpe.Codec(*ranks)
    texts = ["", "  \n\n a  ", "İstanbul K 日本語 😀😀 ñ́", "a" * 3000, " " * 500, "don't we'LL 12345 ½ ²", "\x00\x1f  x\xa0　y", "▁▁<unk></s><|endoftext|>"]
    ids = codec.encode(texts)
    assert ids == [" ".join(map(str, encoding.encode_ordinary(t))) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def _mix_targets(sizes: dict, weights=(3, 1, 2), share=1.5) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
        left = share * sum(sizes.values()) - sum(target.values())
        free -= set(above)
    return target


def test_mixing(docs):
    size = {(i, t, s): len(WORD.findall((t or "").encode())) for i, t, s in ROWS}
    sources = Counter()
    for i, t, s in ROWS:
        sources[s] += size[i, t, s]
    target = _mix_targets(sources)
    rows = mixing.mixed(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter(ROWS)
    taken, largest = Counter(), Counter()
    for r in rows:
        s = r["source"]
        assert r["mix_size"] == size[r["doc_id"], r["text"], s] and r["mix_source_size"] == sources[s]
        assert r["mix_target"] == pytest.approx(target[s])
        assert r["mix_times"] * r["mix_size"] <= 2 * r["mix_size"]
        assert r["mix_times"] >= int(target[s] / max(1, sources[s]))
        taken[s] += r["mix_times"] * r["mix_size"]
        largest[s] = max(largest[s], r["mix_size"])
    for s in sources:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mixing.mixed(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["mix_size"], r["mix_times"]) for r in rows) == Counter((r["doc_id"], r["mix_size"], r["mix_times"]) for r in again)


@pytest.mark.parametrize("weight", [1.0, 0.05, 40.0])
def test_mixing_takes_the_sample_order(spark, weight):
    """The rows taken once more are the first ones by the exponential keys, up to the budget; rows of one id have one key."""
    rows = [(i, "a" if i < 300 else "b" if i < 330 else None, (i * 7) % 13 + 1) for i in range(360)] + [(i, "a", 20) for i in range(0, 300, 3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mixed(table, size=table["size"], weight=F.lit(weight)).collect()
    key = lambda i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / max(weight, 0.05)
    for s in ("a", "b", None):
        own = sorted((r for r in out if r["source"] == s), key=lambda r: (key(r["doc_id"]), r["doc_id"], r["size"]))
        epochs = int(own[0]["mix_target"] / own[0]["mix_source_size"] + 1e-12)
        rest, before, open_ = own[0]["mix_target"] - epochs * own[0]["mix_source_size"], 0, True
        for r in own:
            open_ = open_ and before + r["size"] / 2 <= rest
            assert r["mix_times"] == epochs + open_
            before += r["size"]


def test_quality_weight(spark):
    rows = [(None, 0.0), ("", 0.0), ("ab c", 1.0), ("ab12", 0.5), ("тёплый д", 1.0), ("中文。。", 0.5), ("<p>a</p>", 3 / 8)]
    table = spark.createDataFrame(rows, "text string, weight double")
    assert [r[0] for r in table.select(mixing.quality_weight(F.col("text"))).collect()] == [w for _, w in rows]


def _ppm(rows: list[bytes], order: int = 3):
    """Chances by the definition: walk down from the longest context, leaving out what was seen."""
    counts: dict = {}
    for t in rows:
        padded = b"\0" * order + t
        for p in range(order, len(padded)):
            for k in range(order + 1):
                c = counts.setdefault(padded[p - k : p], Counter())
                c[padded[p]] += 1

    def log10(text: bytes) -> float:
        padded, total = b"\0" * order + text, 0.0
        for p in range(order, len(padded)):
            out: set = set()
            chance = None
            for k in range(order, -1, -1):
                own = {s: n for s, n in counts.get(padded[p - k : p], {}).items() if s not in out}
                if not own:
                    continue
                n, t = sum(own.values()), len(own)
                full = len(out) + t == 256
                if padded[p] in own:
                    chance = own[padded[p]] / (n + (0 if full else t))
                    break
                total += math.log10(t / (n + t))
                out |= set(own)
            total += math.log10(chance if chance is not None else 1 / (256 - len(out)))
        return total

    return log10


def test_language_model(docs, monkeypatch):
    monkeypatch.setattr(lm, "NODES", 1 << 40)  # all strings and contexts are kept
    monkeypatch.setattr(lm, "CONTEXTS", 1 << 40)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode()
    train = [lower(t) for i, t, _ in ROWS if not held(i)]
    counts = Counter(w for t in train for w in WORD.findall(t))
    end, n = len(train), sum(counts.values()) + len(train)
    below = n + 0.1 * (len(counts) + 1 + 1)
    log10 = _ppm(train)
    rows = lm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()
    assert len(rows) == len(ROWS)
    expected = {}
    for i, t, _ in ROWS:
        words = WORD.findall(lower(t))
        base = sum(math.log10((counts[w] + 0.1) / below) for w in words) + math.log10((end + 0.1) / below)
        expected.setdefault((i, len(words) + 1, round(base, 4)), (held(i), sum(counts[w] > 0 for w in words) + 1, log10(lower(t))))
    for r in rows:
        h, known, score = expected[r["doc_id"], r["n_tokens"], round(r["base_score"], 4)]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, n)
        assert r["score"] == pytest.approx(score, rel=1e-4, abs=1e-3)


def test_language_model_rows_are_distributions():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 3000).astype(np.uint8)
    grams = [sum(text[3 - k : len(text) - k].astype(np.int64) << 8 * k for k in range(length)) for length in range(1, 5)]
    table = lm.ppm_table([np.unique(g, return_counts=True) for g in grams], 4)
    assert np.allclose((10.0 ** table["logs"].astype(np.float64)).sum(1), 1, atol=1e-4)


def test_language_model_with_rare_words_joined(docs, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.lm_scores(docs, F.lit(False)).collect()}
    monkeypatch.setattr(lm, "KNOWN", 20)
    got = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in lm.lm_scores(docs, F.lit(False)).collect()}
    assert got == want


@pytest.mark.parametrize("contexts", [1 << 15, 40, 0])
def test_language_model_keeps_all_contexts(spark, monkeypatch, contexts):
    """Every counted context counts, whatever the size of the training texts and whichever contexts are broadcast."""
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(900))) for i in range(24)] + [(30, "rare qzx qzy"), (31, "qzx QZw é new"), (32, ""), (33, None)]
    held = {20, 21, 31}
    log10 = _ppm([(t or "").lower().encode() for i, t in rows if i not in held])
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").isin(*held)).collect()}
    assert got == {i: pytest.approx(log10((t or "").lower().encode()), rel=1e-5, abs=1e-4) for i, t in rows}


def test_language_model_of_all_bytes(spark, monkeypatch):
    """Contexts after which every byte was seen have nothing to escape to; without training all bytes are alike."""
    monkeypatch.setattr(lm, "CONTEXTS", 0)
    rng = random.Random(9)
    rows = [(i, "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x800), 0x4E00 + rng.randrange(99)])) for _ in range(4000)).replace("İ", "")) for i in range(4)]
    lower = lambda t: t.encode().lower()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    log10 = _ppm([lower(t) for i, t in rows if i])
    assert {r["doc_id"]: r["score"] for r in lm.lm_scores(table, F.col("doc_id") == 0).collect()} == {i: pytest.approx(log10(lower(t)), rel=1e-5) for i, t in rows}
    assert lm.lm_scores(table.where("doc_id = 1"), F.lit(True)).first()["score"] == pytest.approx(-len(rows[1][1].encode()) * math.log10(256))


@pytest.mark.parametrize("words", [True, False])
def test_hot_minimiser_twice_in_a_segment(spark, monkeypatch, words):
    """A line that stands twice close together in one document and once in another, before the same passage."""
    monkeypatch.setattr(segments, "BYTES_A_ROUTE", 1)
    rng = random.Random(12)
    some = lambda n: " ".join("%x" % rng.randrange(1 << 28) for _ in range(n))
    rows = []
    for i in range(150):
        line, after = some(8 if words else 9), some(60)
        rows += [(2 * i, f"{some(60)} {line} a b c {line} {after}", "x"), (2 * i + 1, f"{some(60)} other c {line} {after}", "x")]
    rows += [(1000, "y" * 6000, "x"), (1001, "z " + "y" * 5000 + " z", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if words:
        expected, got = _without_repeats(True, 50, rows, True), fm_dedup.substring_dedup(table).withColumn("n_spans", F.lit(0)).withColumnRenamed("n_words", "n")
    else:
        expected, got = _without_repeats(False, 200, rows, False), suffix_dedup.repeated_bytes(table).withColumnRenamed("n_bytes", "n")
    assert {r["doc_id"]: (r["n"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == {i: tuple(expected[i, t][k] for k in (0, 1, 3)) for i, t, _ in rows}


@pytest.mark.parametrize("words", [True, False])
def test_minimisers_of_many_bytes(docs, monkeypatch, words):
    """No index is given more than BYTES_A_ROUTE of several segments of one minimiser; what is found is the same, and comes from the index."""
    monkeypatch.setattr(segments, "BYTES_A_ROUTE", 1000)
    monkeypatch.setattr(segments, "BYTES_A_SHARD", 1)
    windows = segments.Windows(words, *((50, 8, True) if words else (200, 64, False)))
    index = fm_dedup.repeated_windows if words else suffix_dedup.repeated_windows

    def bounded(contents, *others):
        assert sum(map(len, contents)) <= 1000 or len(set(contents)) == 1
        return index(contents, *others)

    expected = _without_repeats(words, windows.length, list(dict.fromkeys(ROWS)), words)
    want = Counter((i, *(expected[i, t][k] for k in (0, 1, 3))) for i, t, _ in ROWS)
    assert multiset(segments.removed_repeats(docs, windows, bounded, "doc_id", "text"), "doc_id", "n", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("words", [True, False])
def test_only_the_index_tells_what_repeats(docs, words):
    """Without a search nothing goes, even if all is used that is known of the segments before; only those of hot minimisers are merged, and here are none."""
    windows = segments.Windows(words, *((50, 8, True) if words else (200, 64, False)))

    def told(contents, documents, lasts, times):
        return [[(0, len(windows.split(c)) - windows.length + 1, d)] if d < last or k > 1 else [] for c, d, last, k in zip(contents, documents, lasts, times, strict=True)]

    assert segments.removed_repeats(docs, windows, told, "doc_id", "text").agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("words", [True, False])
def test_longer_grams_are_decided_by_the_window(words):
    """Equal windows get equal keys at every length, wherever they stand."""
    windows = segments.Windows(words, *((50, 8, True) if words else (200, 64, False)))
    rng, keys = random.Random(7), {}
    base = [rng.choice([b"a", b"b", b"c"]) for _ in range(700)] + [b"a"] * 400 + [b"b", b"a"] * 200
    for _ in range(60):
        a = rng.randrange(len(base) - 400)
        own = [rng.choice([b"a", b"c"]) for _ in range(rng.randrange(90))] + base[a : a + 400]
        todo = [(route, -1, a, own[a : a + n + windows.length - 1]) for route, a, n, _ in zip(*(x.tolist() for x in windows.runs(windows.symbols(own if words else b"".join(own)))), strict=True)]
        assert sum(len(x[3]) - windows.length + 1 for x in todo) == len(own) - windows.length + 1
        for size in windows.grams()[:-1]:
            parts = []
            for route, anchor, at, units in todo:
                symbols = windows.symbols(units if words else b"".join(units))
                for key, first, n, place in zip(*(x.tolist() for x in windows.longer(symbols, np.uint64(route).view(np.int64), anchor, size)), strict=True):
                    parts.append((key, place, at + first, units[first : first + n + windows.length - 1]))
                    for p in range(first, first + n):
                        assert keys.setdefault((size, b" ".join(units[p : p + windows.length])), key) == key
            assert sum(len(x[3]) - windows.length + 1 for x in parts) == len(own) - windows.length + 1
            todo = parts
