"""Sub-positions, voted order, packed statements, dense ids, tag levels, routes and banded alignment on small and random tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.functions import values
from textloom.operators import alignment, models, numbering, relations, routing, segmentation, spans
from textloom.sinks import exporters


def span_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, idx int, start int, end int, start_sub int, end_sub int")


def test_sub_positions_decide_at_one_place(spark):
    parent = span_table(spark, [(1, 0, 0, 10, 0, 1), (1, 1, 10, 10, 1, 2), (1, 2, 10, 20, 2, 0), (2, 0, 0, 10, None, None), (2, 1, 10, 20, None, None)])
    child = span_table(spark, [(1, 0, 10, 10, 0, 0), (1, 1, 10, 10, 2, 2), (1, 2, 10, 12, 2, 0), (1, 3, 10, 10, 9, 9), (2, 0, 10, 10, 5, 5), (2, 1, 10, 12, 1, 1)])
    got = {(r["doc_id"], r["idx"]): r["parent_idx"] for r in spans.parents(child, parent).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (2, 0): 0, (2, 1): 1}
    plain = {(r["doc_id"], r["idx"]): r["parent_idx"] for r in spans.parents(child.drop("start_sub", "end_sub"), parent).collect()}  # one side has none
    assert plain == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 0, (2, 0): 0, (2, 1): 1}
    apart = span_table(spark, [(1, 0, 0, 10, 0, 1), (1, 1, 10, 20, 2, 0)])
    assert [r["parent_idx"] for r in spans.parents_disjoint(child.where("doc_id = 1"), apart).orderBy("idx").collect()] == [0, 1, 1, 1]
    assert [r["parent_idx"] for r in spans.parents(child.where("doc_id = 1"), apart, disjoint=True).orderBy("idx").collect()] == [0, 1, 1, 1]


def test_disjoint_parents_by_either_way(spark):
    rng, parent, child = random.Random(1), [], []
    for d in range(20):
        edges = sorted(rng.sample(range(5000), 40))
        parent += [(d, i, a, b) for i, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True))]
        child += [(d, i, a, a + rng.randint(0, 30)) for i, a in enumerate(sorted(rng.sample(range(5000), 80)))]
    parent, child = (spark.createDataFrame(x, "doc_id long, idx int, start int, end int") for x in (parent, child))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spans.parents(child, parent)) == rows(spans.parents(child, parent, disjoint=True))
    assert rows(spans.orphans(child, parent)) == rows(spans.orphans(child, parent, disjoint=True))
    assert rows(spans.children(parent, child)) == rows(spans.children(parent, child, disjoint=True))
    assert rows(numbering.relative(child, parent)) == rows(numbering.relative(child, parent, disjoint=True))


def test_events_by_sub_position(spark):
    marks = span_table(spark, [(1, 0, 0, 4, 2, 0), (1, 1, 0, 4, 1, 5), (1, 2, 0, 9, None, None)])
    got = [(r["at"], r["opens"], r["idx"]) for r in spans.events({"m": marks}).orderBy("rank").collect()]
    assert got == [(0, True, 2), (0, True, 1), (0, True, 0), (4, False, 0), (4, False, 1), (9, False, 2)]


def test_voted_order(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, idx int, start int, end int")
    a = table([(d, 0, 0, 10) for d in range(5)])
    b = table([(d, 0, 0, 10) for d in range(5)] + [(9, 0, 2, 3)])  # one is in no a
    c = table([(d, 0, 0, 10 if d else 8) for d in range(5)])
    assert list(spans.writing_order({"b": b, "c": c, "a": a})) == ["a", "b", "c"]
    assert list(spans.writing_order({"z": a, "y": a})) == ["y", "z"]  # by name
    opened = [r["annotation"] for r in spans.events(spans.writing_order({"c": c, "b": b, "a": a})).where("doc_id = 1 and opens").orderBy("rank").collect()]
    assert opened == ["a", "b", "c"]
    votes = {(r["outer"], r["inner"]): r["n"] for r in spans.element_order({"a": a, "b": b, "c": c}).collect()}
    assert votes["a", "c"] == 5 and votes["c", "a"] == 4 and votes["a", "b"] == 5 and votes["b", "a"] == 5
    assert list(spans.writing_order({"only": a})) == ["only"]


@pytest.mark.parametrize("most", [60, 500, 900_000])
def test_packed_statements(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice([None, "a'b", "åäö\\", "x" * rng.randint(0, 90)])) for i in range(300)] + [(None, "n"), (5, "again")]
    table = spark.createDataFrame(rows, "k int, v string").repartition(5)
    got = exporters.sql_packets(table, "t", "k", most).collect()
    head = "INSERT INTO `t` (`k`, `v`) VALUES\n"
    assert all(r["statement"].startswith(head) and r["statement"].endswith(";") and r["n_bytes"] == len(r["statement"].encode()) for r in got)
    assert all(r["n_bytes"] <= most or r["n_rows"] == 1 for r in got) and sum(r["n_rows"] for r in got) == len(rows)
    lines = Counter(line for r in got for line in r["statement"][len(head) : -1].split(",\n"))
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "''") + "'"
    assert lines == Counter(f"({'NULL' if k is None else k}, {quoted(v)})" for k, v in rows)
    assert exporters.sql_packets(table.limit(0), "t", "k").count() == 0


def test_dense_ids(spark):
    rows = [(random.Random(i).choice("abcdefgh"), i % 7) for i in range(400)]
    got = [(r["id"], r["s"], r["n"]) for r in numbering.ranked_ids(spark.createDataFrame(rows, "s string, n int").repartition(6), ["s", "n"], start=10).collect()]
    assert sorted(g[0] for g in got) == list(range(10, 410)) and [g[1:] for g in sorted(got)] == sorted(rows)
    assert numbering.ranked_ids(spark.createDataFrame([], "s string"), ["s"]).count() == 0


def test_strings_of_relations(spark):
    rel = spark.createDataFrame([("a", "NN", "SS", "b", "VB", "", 3), ("a", "NN", "OO", "a", "NN", "", 2), ("b", "VB", "SS", "a", "NN", "x", 1)], "head string, head_pos string, relation string, dep string, dep_pos string, extra string, freq long")
    heads = rel.groupBy("head", "head_pos", "relation").agg(F.sum("freq").alias("freq"))
    out = relations.relation_strings({"relations": rel, "head_relation": heads, "relation": rel.groupBy("relation").count()})
    strings = {r["id"]: (r["string"], r["extra"], r["pos"]) for r in out["strings"].collect()}
    assert strings == {0: ("a", "", "NN"), 1: ("a", "x", "NN"), 2: ("b", "", "VB")}
    back = {(strings[r["head"]][::2], r["relation"], strings[r["dep"]], r["freq"]) for r in out["relations"].collect()}
    assert back == {(("a", "NN"), "SS", ("b", "", "VB"), 3), (("a", "NN"), "OO", ("a", "", "NN"), 2), (("b", "VB"), "SS", ("a", "x", "NN"), 1)}
    assert {(r["head"], r["relation"], r["freq"]) for r in out["head_relation"].collect()} == {(0, "SS", 3), (0, "OO", 2), (2, "SS", 1)}
    assert set(out["relation"].columns) == {"relation", "count"}


def test_levels_of_tags(spark):
    mapping = spark.createDataFrame([("nn u sg", "A"), ("nn u sg", "B"), ("nn n pl", "C"), ("vb", "V"), ("vb pres", "W")], "tag string, msd string")
    tags = spark.createDataFrame([(t,) for t in ("nn u sg", "nn m sg", "nn f sg", "nn x", "vb pret", "vb pres", "xx y", None, "nn u sg", "")], "tag string")
    got = {r["tag"]: (r["level"], r["msds"]) for r in models.resolved_tags(tags, mapping).collect()}
    assert got == {"nn u sg": ("exact", ["A", "B"]), "nn m sg": ("gender", ["A", "B"]), "nn f sg": ("gender", ["A", "B"]), "nn x": ("all of it", ["A", "B", "C"]), "vb pret": ("part of speech", ["V"]), "vb pres": ("exact", ["W"]), "xx y": (None, []), "": (None, [])}


def test_old_lexicon(spark):
    schema = "form string, lemma string, baseform string, pos string, inherent array<string>, tag string"
    entries = spark.createDataFrame([("hus", "hus..nn.1", "hus", "nn", ["n"], "pl"), ("röd  hus", "rh..nnm.1", "röd hus", "nnm", ["-"], "sg"), ("gå", "gå..vb.1", "gå", "??", [], "x"), ("oj", "oj..in.1", "oj", "??", [], "x"), ("", "e..nn.1", "e", "nn", [], "")], schema)
    mapping, fallback = spark.createDataFrame([("nn n pl", "C")], "tag string, msd string"), spark.createDataFrame([("vb", ["VB"])], "pos string, tags array<string>")
    words, multi = models.historical_lexicon(entries, mapping, fallback)
    assert {(r["form"], tuple(r["tags"]), tuple(r["levels"])) for r in words.collect()} == {("hus", ("C",), ("exact",)), ("gå", ("VB",), ("lemgram",))}
    assert [(r["words"], r["reading"]) for r in multi.collect()] == [(["röd", "hus"], "rh..nnm.1")]
    plain, _ = models.historical_lexicon(entries, mapping, translate=False)
    assert {(r["form"], r["tags"][0]) for r in plain.collect()} == {("hus", "nn pl"), ("gå", "?? x"), ("oj", "?? x")}


def test_routes(spark):
    rows = [(1, 0, i, "w") for i in range(3)] + [(1, 1, i, "w") for i in range(3, 9)] + [(1, 2, i, "w") for i in range(9, 30)] + [(1, 3, 30, "w" * 20), (1, 3, 31, None), (1, None, 32, "orphan")]
    tokens = spark.createDataFrame(rows, "doc_id long, sentence int, idx int, word string")
    own = routing.routes(tokens, most_tokens=10, longest_sentence=4, longest_token=10)
    assert {(r["sentence"], r["route"]) for r in own.collect()} == {(0, "full"), (1, "tags"), (2, "none"), (3, "none"), (None, "tags")}
    assert {r["route"] for r in routing.routes(tokens).where("sentence is not null").collect()} == {"full"}
    out = routing.routed(own, {"full": lambda df: df.withColumns({"pos": F.lit("P"), "head": F.lit(1)}), "tags": lambda df: df.withColumn("pos", F.lit("T"))})
    assert {(r["route"], r["pos"], r["head"]) for r in out.collect()} == {("full", "P", 1), ("tags", "T", None), ("none", None, None)} and out.count() == len(rows)


def _plain_cost(left, right):
    a, b = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(right)])
    cost = {(0, 0): 0.0}
    one = lambda x, y, p: float(alignment.bead_costs(np.array([float(x)]), np.array([float(y)]), p)[0])
    for i in range(len(left) + 1):
        for j in range(len(right) + 1):
            if i or j:
                cost[i, j] = min(cost[i - x, j - y] + one(a[i] - a[i - x], b[j] - b[j - y], p) for (x, y), p in alignment.BEADS.items() if i >= x and j >= y)
    return cost[len(left), len(right)]


@pytest.mark.parametrize(("few", "width"), [(0, 2), (0, 9), (1 << 20, 64)])
def test_alignment_in_a_band(monkeypatch, few, width):
    monkeypatch.setattr(alignment, "FEW", few)
    rng = random.Random(width)
    for _ in range(12):
        left = [rng.randint(1, 80) for _ in range(rng.randint(0, 30))]
        right = [rng.randint(1, 80) for _ in range(rng.randint(0, 20))] if rng.random() < 0.2 else [x + rng.randint(0, 5) for x in left if rng.random() < 0.9]
        got = alignment.aligned_lengths(left, right, width)
        assert [x for g in got for x in range(g[0], g[1])] == list(range(len(left))) and [x for g in got for x in range(g[2], g[3])] == list(range(len(right)))
        cost = sum(float(alignment.bead_costs(np.array([float(sum(left[i:i1]))]), np.array([float(sum(right[j:j1]))]), alignment.BEADS[i1 - i, j1 - j])[0]) for i, i1, j, j1 in got)
        assert abs(cost - _plain_cost(left, right)) < 1e-6


def test_alignment_of_versions(spark):
    """Every third sentence is joined with the one before it; the beads are just so."""
    rng = random.Random(8)
    lengths = [rng.randint(30, 200) for _ in range(300)]
    joined = [(i, x + (lengths[i + 1] if i % 3 == 1 else 0)) for i, x in enumerate(lengths) if i % 3 != 2]
    left = spark.createDataFrame([("a", i, x) for i, x in enumerate(lengths)] + [("only left", 0, 5), (None, 0, 7)], "link string, idx int, length int")
    right = spark.createDataFrame([("a", i, x) for i, x in joined] + [("only right", 0, None)], "link string, idx int, length int")
    beads = {}
    for r in alignment.align(left, right).collect():
        beads.setdefault((r["link"], r["bead"]), {"left": [], "right": []})[r["side"]].append(r["idx"])
    want = {(i,) if i % 3 == 0 else (i, i + 1): i for i in range(300) if i % 3 != 2}
    assert {tuple(b["left"]): b["right"][0] for (link, _), b in beads.items() if link == "a"} == want
    assert beads["only left", 0] == {"left": [0], "right": []} and beads["only right", 0] == {"left": [], "right": [0]} and (None, 0) in beads


def _refuse(monkeypatch):
    for name in ("_small", "_banded"):
        monkeypatch.setattr(alignment, name, lambda *a: pytest.fail("cells are worked out where the beads can be read off"))


def test_copies_are_aligned_in_one_pass(spark, monkeypatch):
    rows = [("long", i, 1 + i * 7 % 90) for i in range(5_000)] + [(f"line {k}", i, 3 + i) for k in range(2_000) for i in range(k % 4)] + [(None, 0, 7)]
    table = spark.createDataFrame(rows, "link string, idx long, length int")
    want = sorted((str(link), i, side, i) for link, i, _ in rows for side in ("left", "right"))
    assert sorted((str(r["link"]), r["bead"], r["side"], r["idx"]) for r in alignment.align(table, table).collect()) == want
    _refuse(monkeypatch)
    assert alignment.aligned_lengths([5, 9, 5], [5, 9, 5]) == [(0, 1, 0, 1), (1, 2, 1, 2), (2, 3, 2, 3)]
    assert alignment.aligned_lengths([4] * 100_000, [4] * 100_000)[-1] == (99_999, 100_000, 99_999, 100_000)


def test_versions_are_aligned_in_one_pass(spark, monkeypatch):
    """Every third sentence is joined with the one before it; some chunks have one side only."""
    lengths = [20 + i * 37 % 150 for i in range(30_000)]
    joined = [(i, x + (lengths[i + 1] if i % 3 == 1 else 0)) for i, x in enumerate(lengths) if i % 3 != 2]
    _refuse(monkeypatch)
    want = [(i, i + 1 + (i % 3 == 1), k, k + 1) for k, (i, _) in enumerate(joined)]
    assert alignment.aligned_lengths(lengths, [x for _, x in joined]) == want
    assert alignment.aligned_lengths([x for _, x in joined], lengths) == [(c, d, a, b) for a, b, c, d in want]
    links = range(300)
    left = spark.createDataFrame([(k, i, lengths[i]) for k in links if k % 10 != 3 for i in range(300)], "link int, idx int, length int")
    right = spark.createDataFrame([(k, i, x) for k in links if k % 10 != 7 for i, x in joined if i < 300], "link int, idx int, length int")
    got = alignment.align(left, right).groupBy("link", "side").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("idx"), F.countDistinct("bead").alias("beads")).collect()
    both = {(r["link"], r["side"]): (r["n"], r["idx"], r["beads"]) for r in got}
    assert both == {(k, side): (n, n, 200 if k % 10 not in (3, 7) else n) for k in links for side, n in (("left", 300), ("right", 200)) if k % 10 != (3 if side == "left" else 7)}


def test_versions_are_segmented_and_shuffled_once(spark, tmp_path):
    """Both versions come from one exchange, and neither is shuffled again before it is aligned."""
    texts = [" ".join(f"w{k * i}." for i in range(k % 9)) for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.aligned_sentences(spark, str(tmp_path))
    want = {(k, side, i, 1) for k in range(40) for i in range(k % 9) for side in ("left", "right") if side == "left" or i % 3 != 2}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert len(re.findall(r"\bMapInArrow\b", plan)) == 2 and len(re.findall(r"[-:] Exchange\b", plan)) == 2


@pytest.mark.parametrize("dealt", [True, False])
def test_chunks_over_many_batches(spark, monkeypatch, dealt):
    """Chunks that are read off, that are not, and that have one side, over batches of a few rows; sides that are not dealt by the key are right, too."""
    monkeypatch.setattr(alignment, "ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(11)
    pairs = {None: ([3, 4], [7])}
    for k in range(60):
        left = [rng.randint(0 if k % 6 == 0 else 1, 90) for _ in range(rng.randint(0, 25))]
        pairs[f"c{k}"] = left, [sum(left[i : i + 2]) for i in range(0, len(left), 2)] if k % 3 == 0 else [x + k % 3 - 1 for x in left if rng.random() < 0.9 or k % 3 == 1]
    try:
        sides = [spark.createDataFrame([(c, i, x) for c, p in pairs.items() for i, x in enumerate(p[s])], "link string, idx long, length long") for s in (0, 1)]
        found = {}
        for r in alignment.align(*sides, dealt=dealt).collect():
            found.setdefault(r["link"], set()).add((r["bead"], r["side"], r["idx"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, (left, right) in pairs.items():
        beads = alignment.aligned_lengths([max(x, 0) for x in left], [max(x, 0) for x in right])
        assert found.get(c, set()) == {(n, side, x) for n, (i, i1, j, j1) in enumerate(beads) for side, a, b in (("left", i, i1), ("right", j, j1)) for x in range(a, b)}


def test_sentences_by_stops():
    """As cutting after stops and then trimming gives them."""
    def plain(text):
        edges = [0, *(m.end() for m in re.finditer(r"[.!?]+", text)), len(text)]
        return [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in zip(edges, edges[1:], strict=False) if text[a:b].strip()]

    rng, cut = random.Random(2), segmentation._cutter("stops")
    for _ in range(3_000):
        text = "".join(rng.choice("ab.!? \n\t\x0b\x1c\x85\xa0\u3000\u200b\u00e9") for _ in range(rng.randint(0, 14)))
        assert cut(text) == plain(text)


def test_beads_that_are_read_off_are_the_cheapest(monkeypatch):
    assert all(u * x + v * y <= cost + 1e-12 for u, v in alignment.LEAST for (x, y), cost in alignment.COSTS.items())
    # Joined on both sides, or with empty sentences: other beads may be cheaper.
    assert alignment._joined([10, 10, 20], [20, 10, 10]) is None and alignment._joined([3, 0, 4], [3, 4]) is None and alignment._joined([1, 2], [1]) is None
    rng = random.Random(4)
    for _ in range(20):
        left = [rng.randint(1, 9) for _ in range(rng.randint(1, 14))]
        right = []
        for x in left:
            if right and right[-1][1] == 1 and rng.random() < 0.4:
                right[-1] = (right[-1][0] + x, 2)
            else:
                right.append((x, 1))
        right = [x for x, _ in right]
        for a, b in ((left, right), (right, left)):
            assert alignment._joined(a, b) == alignment._small(a, b)


def test_cells_that_a_bound_leaves():
    """All that a cheapest path needs, and few where texts are alike."""
    rng = random.Random(6)
    for k in range(12):
        left = [rng.randint(1, 200) for _ in range(90)]
        right = [x + rng.randint(0, 5) for x in left if rng.random() < 0.97] if k % 2 else [rng.randint(1, 200) for _ in range(80)]
        a, b = (np.concatenate([[0], np.cumsum(x)]).astype(float) for x in (left, right))
        whole = alignment._banded(a, b, *alignment._around(a, b, 1_000))
        cells = alignment._within(a, b, alignment._banded(a, b, *alignment._around(a, b, 3))[1])
        assert cells is None or alignment._banded(a, b, *cells)[:2] == whole[:2]
        if k % 2:
            assert np.maximum(cells[1] - cells[0] + 1, 0).sum() < 0.75 * len(a) * len(b)


def test_value_if_another_is_empty(spark):
    rows = spark.createDataFrame([("c", "|"), ("c", ""), ("c", None), ("c", "|x|")], "c string, s string")
    assert [r[0] for r in rows.select(values.if_empty(F.col("c"), F.col("s"))).collect()] == ["c", "c", "c", ""]


def test_careful_words_with_a_token_list():
    cut = lambda text, **options: [text[a:b] for a, b in segmentation.careful_words(**options)(text)]
    assert cut("(tv- ...och 1:a!?) Wow...") == ["(", "tv", "-", ".", ".", ".", "och", "1", ":", "a", "!", "?", ")", "Wow", ".", ".", "."]
    assert cut("(tv- ...och 1:a!?) Wow...", tokens=("tv-", "1:a"), multi=(r"\.\.\.", r"[!?]+")) == ["(", "tv-", "...", "och", "1:a", "!?", ")", "Wow", "..."]
    assert cut("TV-, Dr. x", tokens=("tv-",), abbreviations=("dr.",)) == ["TV-", ",", "Dr.", "x"]
    assert cut("TV- tv-", tokens=("tv-",), case_sensitive=True) == ["TV", "-", "tv-"]
    assert cut("", multi=("--",)) == [] and cut("--", multi=("--",)) == ["--"] and cut("a--b", multi=("--",)) == ["a", "--", "b"]
