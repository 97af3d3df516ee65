"""The annotation operators on small hand-made texts, and the catalogue against its SQL."""

from __future__ import annotations

import math
import os
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.functions import dates, tags, values
from textloom.operators import alignment, frequency, lexicon, models, numbering, readability, relations, segmentation, spans
from textloom.plans import names
from textloom.sinks import exporters, trees
from textloom.sources import importers

SF = "/root/testdata/sf0.001"


def spans_of(df):
    return [(r["start"], r["end"]) for r in df.orderBy("doc_id", "idx").collect()]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("segmenter", "text", "pieces"),
    [
        ("whitespace", " a  bc\n", ["a", "bc"]),
        ("words_and_punctuation", "don't (stop)!!", ["don", "'", "t", "(", "stop", ")!!"]),
        ("blank_lines", "a\nb\n \nc\n\n\nd", ["a\nb", "c", "d"]),
        ("line_breaks", "a b\n  c\n", ["a b", "c"]),
        ("stops", "One. Two! Three?! four", ["One.", "Two!", "Three?!", "four"]),
        ("section_signs", "x\n§ 1 a\n..§ 2 b", ["x", "§ 1 a", "..§ 2 b"]),
        ("careful_words", "He (said) 3.5, don't.", ["He", "(", "said", ")", "3.5", ",", "don't", "."]),
        ("trained_sentences", "A. Smith left. then he came? Yes.", ["A. Smith left. then he came?", "Yes."]),
    ],
)
def test_segmenters(spark, segmenter, text, pieces):
    got = segmentation.segment(texts(spark, text), segmenter)
    assert [text[a:b] for a, b in spans_of(got)] == pieces


def test_segments_respect_chunks_and_existing_spans(spark):
    docs = texts(spark, "one two three four", None, "")
    chunks = spark.createDataFrame([(0, 0, 0, 5)], "doc_id long, idx int, start int, end int")
    assert spans_of(segmentation.segment(docs, "whitespace", chunks=chunks)) == [(0, 3), (4, 5), (5, 7), (8, 13), (14, 18)]
    kept = spark.createDataFrame([(0, 0, 4, 13)], "doc_id long, idx int, start int, end int")
    assert spans_of(segmentation.segment(docs, "whitespace", existing=kept)) == [(0, 3), (4, 13), (14, 18)]


def test_containment_forms_agree(spark, monkeypatch):
    monkeypatch.setattr(spans, "BIN", 7)
    rng = random.Random(1)
    child, parent = [], []
    for doc in range(6):
        at = 0
        for i in range(40):
            at += rng.randint(0, 3)
            child.append((doc, i, at, at + rng.randint(1, 4)))
            at = child[-1][3]
        at = 0
        for i in range(12):
            at += rng.randint(0, 5)
            parent.append((doc, i, at, at + rng.randint(1, 15)))
            at = parent[-1][3]
    schema = "doc_id long, idx int, start int, end int"
    c, p = spark.createDataFrame(child, schema), spark.createDataFrame(parent, schema)
    expected = {(d, i): next((j for e, j, x, y in parent if e == d and x <= a and b <= y), None) for d, i, a, b in child}
    for form in (spans.parents, spans.parents_disjoint, spans.parents_in_order):
        assert {(r["doc_id"], r["idx"]): None if r["parent_idx"] is None else int(r["parent_idx"]) for r in form(c, p).collect()} == expected
    inside = {(r["doc_id"], r["idx"]): r["children"] for r in spans.children(p, c).collect()}
    assert inside == {(d, j): [i for (e, i), q in sorted(expected.items()) if e == d and q == j] for d, j, _, _ in parent}
    assert spans.orphans(c, p).count() == sum(q is None for q in expected.values())


def test_sweep_gives_up_parents(spark):
    schema = "doc_id long, idx int, start int, end int"
    parent, child = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 5, 10)], schema), spark.createDataFrame([(0, 0, 0, 9), (0, 1, 1, 3)], schema)
    assert [r["parent_idx"] for r in spans.parents_in_order(child, parent).orderBy("idx").collect()] == [None, None]
    assert [r["parent_idx"] for r in spans.parents(child, parent).orderBy("idx").collect()] == [None, 0]


def test_heads_and_tails(spark):
    docs = texts(spark, "a \n  b\tc")
    got = spans.head_tail(segmentation.segment(docs, "whitespace"), docs).orderBy("idx").collect()
    assert [(r["head"], r["tail"]) for r in got] == [("", r"\s\n"), (r"\s\s", r"\t"), ("", "")]


def test_events_and_overlaps(spark):
    schema = "doc_id long, idx int, start int, end int"
    outer, inner = spark.createDataFrame([(0, 0, 0, 6)], schema), spark.createDataFrame([(0, 0, 0, 3), (0, 1, 3, 6)], schema)
    order = [(r["annotation"], r["idx"], r["opens"]) for r in spans.events({"s": outer, "t": inner}).orderBy("rank").collect()]
    assert order == [("s", 0, True), ("t", 0, True), ("t", 0, False), ("t", 1, True), ("t", 1, False), ("s", 0, False)]
    crossing = spark.createDataFrame([(0, "a", 0, 0, 5), (0, "b", 0, 3, 8)], "doc_id long, annotation string, idx int, start int, end int")
    parts = {(r["annotation"], r["part"]): (r["start"], r["end"]) for r in spans.split_overlaps(crossing).collect()}
    assert parts == {("a", 0): (0, 5), ("b", 0): (3, 5), ("b", 1): (5, 8)}


def test_numbers(spark):
    table = spark.createDataFrame([(0, i, i, i + 1, v) for i, v in enumerate(["a10", "a9", "b1", "10", "9", "a9"])], "doc_id long, idx int, start int, end int, v string")
    assert [r["number"] for r in numbering.by_attribute(table, "v").orderBy("idx").collect()] == ["4", "3", "5", "2", "1", "3"]
    assert [r["number"] for r in numbering.by_position(table, prefix="p", zfill=True, start=9).orderBy("idx").collect()] == [f"p{n:02d}" for n in range(9, 15)]
    drawn = {r["idx"]: r["number"] for r in numbering.at_random(table).collect()}
    order = sorted(range(6), key=lambda i: random.Random(i).random())
    assert drawn == {i: str(order.index(i) + 1) for i in range(6)}
    assert len({r["id"] for r in numbering.span_ids(table, "x").collect()}) == 6
    files = spark.createDataFrame([(f"f{i}",) for i in range(40)], "file string")
    assert len({r["file_id"] for r in numbering.file_ids(files).collect()}) == 40


def test_sets(spark):
    frame = spark.createDataFrame([(["å", "b", "c"], [], "|x|y|", "|", "x")], "a array<string>, e array<string>, t string, n string, s string")
    row = frame.select(values.set_text(F.col("a")).alias("t"), values.set_text(F.col("a"), most_bytes=6).alias("cut"), values.set_text(F.col("e")).alias("e"), values.set_values(F.col("t")).alias("v"), values.set_values(F.col("n")).alias("n"), values.set_values(F.col("s")).alias("s")).first()
    assert tuple(row) == ("|å|b|c|", "|å|b|", "|", ["x", "y"], [], ["x"])


def test_scores_compare_as_text(spark):
    frame = spark.createDataFrame([(["a:10", "b:9e-1", "c:9e-1"], [])], "a array<string>, e array<string>")
    assert tuple(frame.select(values.best_of_set(F.col("a")), values.best_of_set(F.col("e")), values.first_of_set(F.col("a"))).first()) == ("b", "", "a:10")


def test_values(spark):
    frame = spark.createDataFrame([("a b", "", "0.125")], "v string, e string, n string")
    row = frame.select(
        values.selected(F.col("v"), 1), values.backed_off(F.col("e"), F.col("v")), values.overridden(F.col("v"), F.lit("|")), values.rounded(F.col("n")), values.joined(F.col("v"), F.col("v"), merge_twins=True),
        values.regex_replaced(F.col("v"), r"(\w) (\w)", r"\2\1"), values.replaced_list(F.col("v"), "x", "y"), values.without_control_characters(F.lit("a\x00\tb")), values.normalised(F.lit("é")),
    ).first()
    assert tuple(row) == ("b", "a b", "a b", "0.12", "a b", "ba", "a b", "a\tb", "é")


@pytest.mark.parametrize(
    ("value", "informat", "expected"),
    [("2020", "%Y", ("20200101 000000", "20201231 235959")), ("2020-02", "%Y-%m", ("20200201 000000", "20200229 235959")), ("2020-02-29", "%Y-%m-%d", ("20200229 000000", "20200229 235959")), ("2020-2-3 4:5", "%Y-%m-%d %H:%M|%Y", ("20200203 040500", "20200203 040559")), ("x", "%Y", ("", "")), ("", "%Y", ("", "")), (" 1999 ", "%Y-%m|%Y", ("19990101 000000", ""))],
)
def test_dates(spark, value, informat, expected):
    frame = spark.createDataFrame([(value,)], "v string")
    assert tuple(frame.select(dates.date_range(F.col("v"), None, informat, "%Y%m%d %H%M%S").alias("d")).first()["d"]) == expected


def test_strict_dates_and_resolutions(spark):
    frame = spark.createDataFrame([("x",)], "v string")
    with pytest.raises(Exception, match="no date format"):
        frame.select(dates.date_range(F.col("v"), None, "%Y", "%Y", strict=True)).collect()
    assert dates.resolutions("%Y|%Y-%m-%d") == "YMD|Y"


def test_tags(spark):
    frame = spark.createDataFrame([("VB", "VB.PRT.AKT"), ("NN", "NN.UTR.SIN.IND.NOM"), ("PC", "PC.PRF.-"), ("MAD", "MAD.X"), ("AB", "AB"), ("VB", "VB.INF.AKT")], "pos string, msd string")
    assert [r[0] for r in frame.select(F.array_join(tags.features(F.col("pos"), F.col("msd")), "|")).collect()] == ["Mood=Ind|Tense=Past|VerbForm=Fin|Voice=Act", "Case=Nom|Definite=Ind|Gender=Com|Number=Sing", "Tense=Past|VerbForm=Part", "", "", "VerbForm=Inf|Voice=Act"]
    assert [r[0] for r in frame.select(tags.upos(F.col("pos"))).collect()] == ["VERB", "NOUN", "VERB", "PUNCT", "ADV", "VERB"]


def _words(spark, *sentences):
    rows = [(0, s, i, w, p) for s, own in enumerate(sentences) for i, (w, p) in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id long, sentence int, idx int, word string, pos string")


def test_readability(spark):
    own = [(w, "NN") for w in "a bc def ghij klmno pqrstu vxyzåäö".split()]
    assert round(readability.lix(_words(spark, own, own, own, own), ["doc_id"], "sentence").first()["lix"], 2) == 21.29
    for times, value in ((1, math.inf), (2, 11.32), (3, 9.88), (4, 9.58)):
        assert round(readability.ovix(_words(spark, *[own] * times), ["doc_id"]).first()["ovix"], 2) == value
    ratio = lambda line: readability.nominal_ratio(_words(spark, [("x", p) for p in line.split()]), ["doc_id"], "pos").first()["nominal_ratio"]
    assert [ratio(x) for x in ("NN JJ", "NN NN VB", "NN PP PC PN AB VB MAD MID", "NN AB VB PP PN PN MAD", "RG VB")] == [math.inf, 2.0, 1.0, 0.5, 0.0]
    frame = spark.createDataFrame([(0.125,), (math.nan,), (math.inf,)], "v double")
    assert [r[0] for r in frame.select(readability.format_number(F.col("v"))).collect()] == ["0.12", "nan", "inf"]


def test_relations(spark):
    columns = "doc_id long, sentence int, idx int, word string, pos string, lemmas array<string>, baseforms array<string>, ref int, head int, relation string"
    rows = [
        (0, 0, 0, "Han", "PN", ["han..pn.1"], ["han"], 1, 1, "SS"), (0, 0, 1, "ges", "VB", ["ge..vb.1"], ["ge"], 2, None, "ROOT"), (0, 0, 2, "vid", "PP", [], ["vid"], 3, 1, "RA"), (0, 0, 3, "behov", "NN", ["behov..nn.1"], ["behov"], 4, 2, "PA"),
        (0, 1, 4, "stor", "JJ", [], ["stor"], 1, 5, "AT"), (0, 1, 5, "hund", "NN", ["hund..nn.1", "stor_hund..nnm.1:4"], ["hund"], 2, None, "ROOT"),
        (0, 2, 6, "x", "VB", [], ["x"], 1, None, ""),
    ]
    found = relations.relations(spark.createDataFrame(rows, columns))
    assert {(r["head"]["word"], r["relation"], r["dep"]["word"], r["extra"]["word"] if r["extra"] else "") for r in found.collect()} == {("ges", "RA", "behov", "vid"), ("vid", "PA", "behov", ""), ("hund", "AT", "stor", ""), ("ges", "OO", "", "")}
    every = relations.triples(found)
    assert ("ge..vb.1", "RA", "behov..nn.1", "vid", 1, 1, 0, 0) in {(r["head"], r["relation"], r["dep"], r["extra"], r["lemma_head"], r["lemma_dep"], r["word_head"], r["word_dep"]) for r in every.collect()}
    counts = relations.relation_counts(every)
    assert {r["relation"] for r in counts["relation"].collect()} == {"ADV", "PA", "AT", "OBJ"}


def test_lexicons(spark):
    tokens = spark.createDataFrame([(0, 0, "Hund", "NN.X"), (0, 1, "katt", "")], "doc_id long, idx int, word string, msd string")
    known = spark.createDataFrame([("hund", "hund..1", ["NN.X"]), ("Hund", "Hund..2", ["PM.Y"]), ("katt", "katt..1", ["NN.X"]), ("katt", "katt..2", ["NN.X"])], "form string, reading string, tags array<string>")
    got = lexicon.readings(tokens, known, least_precision=0.5)
    assert sorted((r["idx"], r["reading"], r["score"]) for r in got.collect()) == [(0, "hund..1", 1.0), (1, "katt..1", 0.5), (1, "katt..2", 0.5)]
    sets = spark.createDataFrame([(0, 0, "a", []), (0, 1, "b", ["own"]), (0, 2, "c", [])], "doc_id long, idx int, word string, lemmas array<string>")
    first, second = spark.createDataFrame([("a", ["1"]), ("b", ["1"])], "form string, values array<string>"), spark.createDataFrame([("a", ["2"]), ("c", ["2"])], "form string, values array<string>")
    assert [r["lemmas"] for r in lexicon.fallback(sets, "lemmas", first, second).orderBy("idx").collect()] == [["1"], ["own"], ["2"]]
    scored = spark.createDataFrame([(0, 0, ["x:0.2", "y:0.8"]), (0, 1, [])], "doc_id long, idx int, senses array<string>")
    assert [(r[0], r[1]) for r in lexicon.sentiment(scored, spark.createDataFrame([("y", -1.0), ("x", 1.0)], "sense string, score double")).orderBy("idx").select("sentiment_score", "sentiment_label").collect()] == [(-1.0, "negative"), (None, "")]
    parts = spark.createDataFrame([("glass", "prefix", 0.1), ("skål", "suffix", 0.2), ("gla", "prefix", 0.5), ("sskål", "suffix", 0.001)], "part string, role string, probability double")
    got = lexicon.compounds(spark.createDataFrame([("glasskål",), ("hej",)], "word string"), parts).collect()
    assert [(r["word"], r["parts"]) for r in got] == [("glasskål", ["glass", "skål"])]
    line = spark.createDataFrame([(0, 0, i, w) for i, w in enumerate("i New York City nu".split())], "doc_id long, sentence int, idx int, word string")
    phrases = spark.createDataFrame([("new york", "ny"), ("new york city", "nyc")], "form string, reading string")
    assert [(r["first"], r["last"], r["reading"]) for r in lexicon.multiwords(line, phrases).collect()] == [(1, 3, "nyc")]


def test_lexicon_builders(spark):
    xml = """<L><LexicalEntry><Lemma><feat att="writtenForm" val="hund"/><feat att="lemgram" val="hund..nn.1"/><feat att="partOfSpeech" val="nn"/><feat att="inherent" val="u"/></Lemma>
      <WordForm><feat att="writtenForm" val="hunden"/><feat att="msd" val="sg def nom"/></WordForm><WordForm><feat att="writtenForm" val="hund"/><feat att="msd" val="ci"/></WordForm>
      <WordForm><feat att="writtenForm" val="varm korv"/><feat att="msd" val="sg"/></WordForm><Sense id="hund..1"/></LexicalEntry><LexicalEntry/></L>"""
    entries = models.lexicon_entries(spark.createDataFrame([(xml,)], "content string"))
    tags_ = spark.createDataFrame([("nn", "sg def nom", "NN.UTR.SIN.DEF.NOM")], "pos string, tag string, msd string")
    assert [tuple(r) for r in models.word_lexicon(entries, tags_).collect()] == [("hunden", "hund..nn.1", "hund", "hund..1", ["NN.UTR.SIN.DEF.NOM"])]
    assert [tuple(r) for r in models.phrase_lexicon(entries).collect()] == [("varm korv", "hund..nn.1")]
    assert {r["part"]: r["params"] for r in models.compound_lexicon(entries).collect()}["hund"] == ["ci"]
    links = spark.createDataFrame([("a", "x", "exactMatch", 1), ("a", "y", "exactMatch", 2), ("a", "z", "other", 3)], "form string, value string, kind string, place int")
    assert [tuple(r) for r in models.pivot_lexicon(links).collect()] == [("a", "y")]
    frames = spark.createDataFrame([("fr--Sewing", ["s..1"])], "frame string, senses array<string>")
    assert [tuple(r) for r in models.frame_lexicon(frames, "fr--").collect()] == [("s..1", "Sewing")]


def test_key_chain(spark):
    first = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "key string, value string")
    assert sorted(tuple(r) for r in spans.chain(first, spark.createDataFrame([("1", "x"), ("2", "y")], "key string, value string"), default="-").collect()) == [("a", "x"), ("b", "y"), ("c", "-")]


def test_frequency_lists(spark):
    tokens = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "word string, pos string")
    assert [tuple(r) for r in frequency.in_list_order(frequency.frequency_list(tokens, ["word", "pos"]), ["word", "pos"]).collect()] == [("a", "", 2), ("b", "x", 1)]
    assert frequency.frequency_list(tokens, ["word"], cutoff=2).count() == 1


def test_import_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.xml").write_text('<text id="1"><head><title>T</title></head><p n="2">a <b>bc</b> d</p><!-- no --><skip>zz</skip></text>', encoding="utf-8")
    got = importers.read_corpus(spark, str(tmp_path / "in"), "xml", header=("head",), skip=("skip",)).first()
    assert (got["doc_id"], got["text"]) == ("one", "a bc d")
    assert [(e["element"], e["start"], e["end"], e["attributes"]) for e in got["elements"]] == [("text", 0, 6, {"id": "1", "head.title": "T"}), ("p", 0, 6, {"n": "2"}), ("b", 2, 4, {})]
    (tmp_path / "in/t.txt").write_bytes("é a\x00b".encode())
    assert importers.read_corpus(spark, str(tmp_path / "in"), "txt").first()["text"] == "é ab"
    with zipfile.ZipFile(tmp_path / "in/d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    assert importers.read_corpus(spark, str(tmp_path / "in"), "docx").first()["text"] == "Hello\tyou\n\nTwo"
    with zipfile.ZipFile(tmp_path / "in/d.odt", "w") as z:
        z.writestr("content.xml", '<o xmlns:t="t"><t:h>Head</t:h><t:p>a<t:s/>b <t:span>c</t:span></t:p></o>')
    assert importers.read_corpus(spark, str(tmp_path / "in"), "odt").first()["text"] == "Head\n\na b c"
    (tmp_path / "in/bad.xml").write_text("<a>")
    assert {r["doc_id"]: r["error"] is None for r in importers.read_corpus(spark, str(tmp_path / "in"), "xml", skip_bad=True).collect()} == {"one": True, "bad": False}


def test_formats(spark, tmp_path):
    tokens = spark.createDataFrame([(7, 0, 0, 0, 1, "a&", "X"), (7, 0, 1, 2, 3, "b", ""), (7, 1, 2, 4, 5, "c", "Y")], "doc_id long, sentence int, idx int, start int, end int, word string, pos string")
    assert exporters.csv(tokens, ["word", "pos"]).first()["content"] == "word\tpos\na&\tX\nb\t\n\nc\tY\n\n"
    assert exporters.vrt(tokens, ["word", "pos"]).first()["content"] == '<text id="7">\n<sentence id="0">\na&amp;\tX\nb\t\n</sentence>\n<sentence id="1">\nc\tY\n</sentence>\n</text>\n'
    assert exporters.conllu(tokens, {"ID": "idx", "FORM": "word", "XPOS": "pos"}).first()["content"].splitlines()[:3] == ["# sent_id = 0", "0\ta&\t_\t_\tX\t_\t_\t_\t_\t_", "1\tb\t_\t_\t_\t_\t_\t_\t_\t_"]
    docs = spark.createDataFrame([(7, "a b c"), (8, "x<y")], "doc_id long, text string")
    assert {r["doc_id"]: r["content"] for r in trees.tree(docs, {"token": tokens}, {"token": ["pos"]}, "preserved").collect()} == {7: '<text id="7"><token pos="X">a</token> <token>b</token> <token pos="Y">c</token></text>\n', 8: '<text id="8">x&lt;y</text>\n'}
    exporters.write_documents(exporters.combined(exporters.xml_pretty(tokens, ["pos"]), "c"), str(tmp_path / "out"), "bzip2")
    assert any(name.endswith(".bz2") for name in os.listdir(tmp_path / "out"))
    assert [r[0] for r in exporters.sql_rows(spark.createDataFrame([(1, "o'x", None)], "a long, b string, c string"), "t").collect()] == ["INSERT INTO `t` (`a`, `b`, `c`) VALUES (1, 'o''x', NULL);"]


def test_export_names():
    assert names.select_annotations(["a", "b", "c"], ["a as x", "...", "not c"]) == {"a": "x", "b": "b"}
    assert names.export_names(["m.word", "n.word", "m.pos"]) == {"m.word": "m.word", "n.word": "n.word", "m.pos": "pos"}
    assert names.without_collisions({"m.a": "a", "m.b": "b"}, ["b"]) == {"m.a": "a", "m.b": "corpus.b"}
    assert [exporters.xml_name(n) for n in ("a.b", "1st", "a b:c", "é")] == ["a.b", "_1st", "a_b_c", "é"]


def test_crossing_spans():
    """Every mark is closed in the order of opening, every piece of text has just the spans that cover it, and parts of a span have one number."""
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        own = sorted({(a, rng.randint(a, n)) for a in (rng.randrange(n) for _ in range(rng.randint(1, 7)))}, key=lambda s: (s[0], s[1] > s[0], -s[1]))
        events, crossing = trees.nested_events(own)
        stack, covered, at, opened = [], [set() for _ in range(n)], 0, [0] * len(own)
        for place, kind, k in events:
            assert place >= at
            for x in range(at, place):
                covered[x] = set(stack)
            at = place
            if kind == "close":
                assert stack.pop() == k
            else:
                stack.append(k)
                opened[k] += 1
        assert not stack
        for x in range(n):
            assert covered[x] == {k for k, (a, b) in enumerate(own) if a <= x < b} or x >= at
        assert {k for k, c in enumerate(opened) if c > 1} <= set(crossing) and all(opened)


def test_trees(spark):
    docs = spark.createDataFrame([(1, "a b. c d"), (2, None), (3, "x")], "doc_id long, text string")
    part = spark.createDataFrame([(1, 0, 0, 8, "p")], "doc_id long, idx int, start int, end int, kind string")
    line = spark.createDataFrame([(1, 0, 0, 4, 1), (1, 1, 5, 8, 0)], "doc_id long, idx int, start int, end int, place int")
    token = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 1, 2, 3, "b"), (1, 2, 3, 4, "."), (1, 3, 5, 6, "c"), (1, 4, 7, 8, "d")], "doc_id long, idx int, start int, end int, word string")
    tables = {"part": part, "line": line, "token": token}
    got = {r["doc_id"]: r["content"] for r in trees.tree(docs, tables, {"part": ["kind"]}).collect()}
    assert got[1] == '<text id="1">\n  <part kind="p">\n    <line>\n      <token>a</token>\n      <token>b</token>\n      <token>.</token>\n    </line>\n    <line>\n      <token>c</token>\n      <token>d</token>\n    </line>\n  </part>\n</text>\n'
    assert got[2] == '<text id="2">\n</text>\n' and got[3] == '<text id="3">\n</text>\n'
    got = {r["doc_id"]: r["content"] for r in trees.tree(docs, tables, {}, "vertical", scramble="line").collect()}
    assert got[1] == '<text id="1">\n<part>\n<line>\nc\nd\n</line>\n<line>\na\nb\n.\n</line>\n</part>\n</text>\n'
    crossing = spark.createDataFrame([(1, 0, 0, 3)], "doc_id long, idx int, start int, end int")
    other = spark.createDataFrame([(1, 0, 2, 6)], "doc_id long, idx int, start int, end int")
    got = {r["doc_id"]: r["content"] for r in trees.tree(docs, {"x": crossing, "y": other}, {}, "preserved").collect()}
    assert got[1] == '<text id="1"><x>a <y overlap="1">b</y></x><y overlap="1">. c</y> d</text>\n' and got[2] == '<text id="2"></text>\n'
    # Two chapters, of which the lines are mixed: their elements are closed and opened around them.
    chapter = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 8)], "doc_id long, idx int, start int, end int")
    got = trees.tree(docs.where("doc_id = 1"), {"chapter": chapter, "line": line, "token": token}, {"chapter": ["idx"]}, "vertical", scramble="line").first()["content"]
    assert got == '<text id="1">\n<chapter idx="1">\n<line>\nc\nd\n</line>\n</chapter>\n<chapter idx="0">\n<line>\na\nb\n.\n</line>\n</chapter>\n</text>\n'


def test_gapped_multiwords(spark):
    def found(text, *entries, most_gaps=1):
        rows = [(1, 0, i, w.split("/")[0], w.split("/")[1]) for i, w in enumerate(text.split())]
        tokens = spark.createDataFrame(rows, "doc_id long, sentence int, idx int, word string, pos string")
        known = spark.createDataFrame([(w.split(), r, g, p) for w, r, g, p in entries], "words array<string>, reading string, gaps boolean, particle boolean")
        out = lexicon.gapped_multiwords(tokens, known, most_gaps)
        return tokens, out, sorted((r["places"], r["reading"]) for r in out.collect())

    take = ("ta hand om", "ta_hand_om..vbm.1", True, True)
    assert found("Ta/VB hand/NN om/PL dem/PN", take)[2] == [([0, 1, 2], "ta_hand_om..vbm.1")]
    assert found("ta/VB sin/PS hand/NN om/PL", take)[2] == [([0, 2, 3], "ta_hand_om..vbm.1")]
    assert found("ta/VB sin/PS hand/NN nu/AB om/PL", take)[2] == []  # two gaps
    assert found("ta/VB sin/PS hand/NN nu/AB om/PL", take, most_gaps=2)[2] == [([0, 2, 4], "ta_hand_om..vbm.1")]
    assert found("ta/VB ge/VB hand/NN om/PL", take)[2] == []  # another verb in a verb's gap
    assert found("ta/VB hand/NN om/PP", take)[2] == []  # the particle is a preposition
    assert found("ta/NN hand/NN om/PL", take)[2] == []  # no verb
    assert found("i/PP stora/JJ dag/NN", ("i dag", "i_dag..abm.1", False, False))[2] == []
    assert found("i/PP dag/NN", ("i dag", "i_dag..abm.1", False, False))[2] == [([0, 1], "i_dag..abm.1")]
    assert found("ju/KN desto/AB", ("ju * desto", "ju_desto..knm.1", True, False))[2] == [([0, 1], "ju_desto..knm.1")]
    # b a b a of one part of speech: a goes; of different ones both stay.
    cross = "b1/NN a1/NN b2/NN a2/NN"
    assert found(cross, ("a1 a2", "a..nnm.1", True, False), ("b1 b2", "b..nnm.1", True, False))[2] == [([0, 2], "b..nnm.1")]
    assert len(found(cross, ("a1 a2", "a..nnm.1", True, False), ("b1 b2", "b..abm.1", True, False))[2]) == 2
    tokens, out, _ = found("ta/VB sin/PS hand/NN om/PL", take)
    sets = lexicon.with_multiwords(tokens.withColumn("lemmas", F.when(F.col("idx") == 0, F.array(F.lit("ta..vb.1"))).otherwise(F.array().cast("array<string>"))), out, "lemmas")
    assert {r["idx"]: r["lemmas"] for r in sets.collect()} == {0: ["ta..vb.1", "ta_hand_om..vbm.1"], 1: [], 2: ["ta_hand_om..vbm.1:0"], 3: ["ta_hand_om..vbm.1:0"]}


def test_alignment(spark):
    """Against all ways to cut both sides into beads."""
    def cheapest(a, b):
        if not a and not b:
            return 0.0
        return min(float(alignment.bead_costs(np.array(float(sum(a[:x]))), np.array(float(sum(b[:y]))), p)) + cheapest(a[x:], b[y:]) for (x, y), p in alignment.BEADS.items() if x <= len(a) and y <= len(b))

    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randint(0, 90) for _ in range(rng.randint(0, 5))] for _ in range(2))
        beads = alignment.aligned_lengths(a, b)
        assert [x for i, i1, _, _ in beads for x in a[i:i1]] == a and [x for _, _, j, j1 in beads for x in b[j:j1]] == b
        cost = sum(float(alignment.bead_costs(np.array(float(sum(a[i:i1]))), np.array(float(sum(b[j:j1]))), alignment.BEADS[i1 - i, j1 - j])) for i, i1, j, j1 in beads)
        assert cost == pytest.approx(cheapest(a, b))
    left = spark.createDataFrame([("x", 0, 100), ("x", 1, 40), ("x", 2, 45), ("y", 0, 9)], "link string, idx long, length long")
    right = spark.createDataFrame([("x", 0, 102), ("x", 1, 88), ("z", 0, None)], "link string, idx long, length long")
    assert sorted(map(tuple, alignment.align(left, right).collect())) == [("x", 0, "left", 0), ("x", 0, "right", 0), ("x", 1, "left", 1), ("x", 1, "left", 2), ("x", 1, "right", 1), ("y", 0, "left", 0), ("z", 0, "right", 0)]


def test_sql_texts(spark):
    rows = spark.createDataFrame([(i, f"n'{i}") for i in range(25)], "id long, name string")
    made = [r["statement"] for r in exporters.sql_inserts(rows, "t", "id", rows_a_statement=10).collect()]
    found = sorted(int(x) for m in made for x in re.findall(r"^\((\d+), 'n''\1'\)", m, re.M))
    assert found == list(range(25)) and all(m.startswith("INSERT INTO `t` (`id`, `name`) VALUES\n(") and m.endswith(");") for m in made)
    assert exporters.sql_inserts(rows.where("false"), "t", "id").count() == 0
    assert exporters.sql_table(rows, "t", ("id",), ("name",))["create"] == "CREATE TABLE `temp_t` (`id` BIGINT, `name` VARCHAR(255), PRIMARY KEY (`id`), INDEX `name` (`name`));"


def test_file_ids_of_many_names(spark):
    got = [r["file_id"] for r in numbering.file_ids(spark.range(20_000).select(F.col("id").cast("string").alias("file"))).collect()]
    assert len(got) == len(set(got)) == 20_000
    some = numbering.file_ids(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "file string")).collect()
    assert sorted(r["file"] for r in some) == ["a", "b"]


def test_tag_sets(spark):
    cases = [("VMN0000", "cat", "EAGLES", "VERB"), ("Fp", "cat", "EAGLES", "PUNCT"), ("NP", "spa", "EAGLES", "PROPN"), ("CS", "rus", "EAGLES", "CONJ"), ("NNP", "eng", "Penn", "PROPN"), ("Fat", "eng", "Penn", "PUNCT"), ("FW", "eng", "Penn", "X"), ("Zu", "eng", "Penn", "NUM"), ("Vpi", "bul", "BulTreeBank", "VERB"),
        ("J.crd", "est", "TreeTagger", "X"), ("V.main", "est", "TreeTagger", "VERB"), ("PrfPrc", "fin", "FinnTreeBank", "VERB"), ("CC_x", "fin", "FinnTreeBank", "CONJ"), ("$.", "nld", "TreeTagger", "PUNCT"), ("nounpl", "nld", "TreeTagger", "NOUN"), ("N:nom", "lat", "TreeTagger", "NOUN"), ("subst:sg", "pol", "NationalCorpusofPolish", "NOUN"),
        ("Vmip", "ron", "MULTEXT", "VERB"), ("Afp", "ron", "MULTEXT", "ADJ"), (",", "slk", "SlovakNationalCorpus", "PUNCT"), ("SSms", "slk", "SlovakNationalCorpus", "NOUN"), (":q", "slk", "SlovakNationalCorpus", "X"), ("$(", "deu", "STTS", "PUNCT"), ("XYZ", "fra", "TreeTagger", "X"), ("PRO:PER", "fra", "TreeTagger", "PRON"),
        ("VMinf", "spa", "TreeTagger", "VERB"), ("ADJ", "spa", "TreeTagger", "ADJ"), ("VER:infi", "ita", "TreeTagger", "VERB"), ("Sp-l", "rus", "TreeTagger", "ADP"), ("NN", "swe", "SUC", "NOUN"), ("N", "swe", "none", "")]
    row = spark.range(1).select(*[tags.upos(F.lit(t), language, kind).alias(f"c{i}") for i, (t, language, kind, _) in enumerate(cases)]).first()
    assert [(c[0], row[i]) for i, c in enumerate(cases)] == [(c[0], c[3]) for c in cases]


def test_streams(spark, tmp_path):
    from textloom.streaming import annotate

    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = segmentation.token_table(annotate.arriving(spark, str(tmp_path / "in"), "doc_id long, text string"))
    annotate.write_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["word"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["tokens", "token_sentence", "head_and_tail", "frequency_list", "grammatical_relations", "relation_association", "date_ranges", "vertical_text", "xml_preserved", "span_events"])
def test_catalogue_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(result.columns) == columns
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_compounds_of_all_tokens(spark, tmp_path):
    """The query splits every word by every word, whatever their lengths and counts."""
    text = "at ut bok utat hund hundbok bibliotek bibliotekhund universitet universitetbibliotekbok glass kål skål glasskål glasskål bokbokbok utbokutbokutbok"
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    tokens = text.split()
    count = {w: tokens.count(w) for w in tokens}

    def splits(word, at=0):
        if at >= len(word):
            yield 1.0, ()
        for b in range(at + 2, len(word) + 1):
            part = word[at:b]
            if part in count and part != word:
                for back in (0, 1) if b < len(word) and part[-1] == part[-2] and part[-1] in "bcdfghjklmnpqrstvwxz" else (0,):
                    for p, rest in splits(word, b - back):
                        yield p * count[part] / 1e6, (part, *rest)

    want = {}
    for word in count:
        found = [s for s in splits(word) if len(s[1]) >= 2]
        if found and len(word) >= 4:
            p, parts = min(found, key=lambda s: (len(s[1]), -s[0], s[1]))
            want[word] = (list(parts), pytest.approx(p))
    assert {"utat", "universitetbibliotekbok", "hundbok"} <= set(want) and len(want["utbokutbokutbok"][0]) == 6
    assert {r["word"]: (r["parts"], r["score"]) for r in catalog.compounds(spark, str(tmp_path)).collect()} == want
