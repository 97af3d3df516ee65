"""Queries over odd and larger tables: the rows of their SQL, and no exchange that grows with the tokens."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.operators import boundaries, phrases, segmentation, spans
from textloom.sinks import trees

ODD = [
    (1, "One line. Two of the words!\n\n  and of the & <third> \"line\"\t|x| \n"), (2, ""), (3, "   \n \t "), (4, "non breaking space\u0085here \x1c and\x0bthere"), (5, "same"), (6, "de la de la\nvon der of of the in the"),
]


def against_sql(spark, folder, name, rows):
    """The rows that only the query has and those that only its SQL has."""
    import duckdb

    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    have, want = Counter(repr(tuple(r)) for r in got.select(*columns).collect()), Counter(map(repr, want))
    return have - want, want - have


def test_documents_without_words_are_counted(spark, tmp_path):
    assert against_sql(spark, tmp_path, "whitespace_token_counts", [*ODD, (7, None), (5, "same id again")]) == (Counter(), Counter())


TREES = ["combined_scrambled_xml", "csv_of_lines", "conllu_of_lines", "xml_of_lines", "xml_preserved", "reversed_vertical_text"]


def exchanges(spark, folder, name):
    spark.createDataFrame(ODD, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    plan = catalog.QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange ", line)]


@pytest.mark.parametrize("name", TREES)
def test_texts_are_written_out_without_an_exchange_of_tokens(spark, tmp_path, name):
    assert not [x for x in exchanges(spark, tmp_path, name) if "rangepartitioning" not in x]  # documents may be sorted
    plain = [(k, t) for k, t in ODD if k != 4]  # white space that SQL and Python tell apart
    assert against_sql(spark, tmp_path, name, plain) == (Counter(), Counter())


@pytest.mark.parametrize("style", ["pretty", "preserved", "vertical", "csv", "conllu"])
@pytest.mark.parametrize("scramble", [None, "part"])
@pytest.mark.parametrize("cut", ["words_and_punctuation", "crossing", "wider"])
def test_segmented_trees_are_those_of_span_tables(spark, style, scramble, cut):
    """Spans of two segmenters, nested or crossing, as the general writer has them."""
    parts = segmentation._matches(r"\[[^\]]*\]")
    inner = {"crossing": segmentation._matches(r"\w+\W?\w+|\S"), "wider": segmentation._matches(r"[^.]+")}.get(cut, cut)
    texts = ["a <b> [cd ef] g. [h|i \"j\"][k] l & m", "", "no part. x", "[one", "[n o]p q[r s]t. [u]"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "doc_id long, text string").coalesce(1)
    columns = ("idx", "word", "word", None, None, None, None, "word", None, None) if style == "conllu" else ("word", "idx")
    attributes = {"part": ["idx"], "token": ["idx"]}
    part = segmentation.segment(docs, parts).withColumn("place", -F.col("idx"))
    want = trees.tree(docs, {"part": part, "token": segmentation.token_table(docs, inner)}, attributes, style, columns, scramble, breaks="part")
    place = {"part": lambda own: {"place": pc.negate(own["idx"])}}
    got = trees.segmented_tree(docs, ("part", parts), ("token", inner), attributes, style, columns, scramble, breaks="part", derived=place)
    assert {r["doc_id"]: r["content"] for r in got.collect()} == {r["doc_id"]: r["content"] for r in want.collect()}


PROSE = [(20 + k, f"the cat of the dog in the old house is of the mind{k}. The cat ran to the house on de la mer! Was it 3. 14 of them, or A. Smith? " * (1 + k % 3)) for k in range(40)]


def plan_of(spark, folder, name):
    spark.createDataFrame(PROSE, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return catalog.QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["class_frequencies", "collocations_across_stops", "relation_association"])
def test_texts_are_read_once_for_all_counts(spark, tmp_path, name):
    assert against_sql(spark, tmp_path, name, PROSE) == (Counter(), Counter())
    assert "documents.parquet" not in plan_of(spark, tmp_path, name)  # only what was counted is


@pytest.mark.parametrize("name", ["multiword_places", "routed_sentences", "phrase_places", "lexicon_annotation"])
def test_sentences_are_gathered_where_they_are_segmented(spark, tmp_path, name):
    assert against_sql(spark, tmp_path, name, [r for r in ODD if r[0] != 4] + PROSE) == (Counter(), Counter())
    plan = plan_of(spark, tmp_path, name)
    assert not re.search(r"collect_list\(struct\(idx|Exchange hashpartitioning\(doc_id#\d+L, (start|\d+\))", plan)


def test_stop_counts_have_the_ratios_of_all_words(spark):
    docs = spark.createDataFrame([r for r in ODD if r[0] != 4] + PROSE, "doc_id long, text string")
    ratios = []
    for words in (boundaries.stop_words(docs), boundaries.stop_counts(docs)):
        marked = boundaries.marked_ends(words, boundaries.stop_ratios(words).where("score >= 0.3"))
        starters = boundaries.starter_ratios(marked)
        ratios.append([sorted(map(repr, df.collect())) for df in (boundaries.stop_ratios(words), starters, boundaries.collocation_ratios(marked, starters.where("log_likelihood > 30")))])
    assert ratios[0] == ratios[1] and all(ratios[0][:2])


def test_lines_of_tokens_are_those_of_containment(spark):
    texts = ["a b. c d e! f", "", "one.two", " . x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crossing = segmentation._matches(r"\w+\.\w+|\w+|[^\w\s]")
    for cut in ("words_and_punctuation", crossing):
        got = segmentation.token_lines(docs, cut, outer="stops").select("doc_id", "sentence", F.posexplode("words").alias("at", "word"), "first").select("doc_id", (F.col("first") + F.col("at")).alias("idx"), "word", "sentence")
        want = spans.parents_disjoint(segmentation.token_table(docs, cut), segmentation.segment(docs, "stops")).select("doc_id", "idx", "word", F.col("parent_idx").alias("sentence"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_lines_are_annotated_as_tokens_are(spark, monkeypatch):
    """Words of rare and frequent pairs, phrases in parts of a trie."""
    monkeypatch.setattr(phrases, "FREQUENT_PAIRS", 3)
    monkeypatch.setattr(phrases, "TRIE_EDGES", 2)
    rows = [(1, s, i, w, t) for s, line in enumerate(["a b c a b", "b a", "c d x e"]) for i, (w, t) in enumerate(zip(line.split(), ["NN.a", "VB.b", "PP", "NN.a", "NN.b"], strict=False))]
    tokens = spark.createDataFrame(rows, "doc_id long, sentence int, idx int, word string, msd string")
    lexicon = spark.createDataFrame([(w, ["NN.a", "VB.b"], [w], [f"{w}..nn.1"], [f"{w}..1"]) for w in "abd"], "form string, tags array<string>, baseforms array<string>, lemgrams array<string>, senses array<string>")
    known = [(["a", "b"], ["a b"], ["a_b..abm.1"], ["s"], True, False), (["b", "a"], ["b a"], ["b_a..nnm.1"], ["t"], False, False), (["d", "e"], ["d e"], ["d_e..abm.1"], [], True, True)]
    trie = phrases.phrase_trie(spark.createDataFrame(known, "words array<string>, baseforms array<string>, lemgrams array<string>, senses array<string>, gaps boolean, particle boolean"))
    lines = tokens.groupBy("doc_id", "sentence").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "msd"))).alias("l")).select("doc_id", "sentence", F.lit(0).alias("first"), F.col("l.word").alias("words"), F.col("l.msd").alias("tags"))
    got = phrases.annotate_lines(lines, tokens.groupBy("word", "msd").agg(F.count("*").alias("n")), lexicon, trie)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, phrases.annotate(tokens, lexicon, trie).collect()))
