"""Lexicon operators: look-ups, readings, compounds, sentiment, classes, places.

Lexicons are tables. What depends on the word form alone is worked out once for each different form and joined back as joins.by_form() does it: the frequent forms are broadcast, of which there is
a fixed number at most, so that no key of a shuffle holds more than a small share of the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.values import reading_precision
from textloom.operators import joins, phrases

#: The reference analyses no longer words.
LONGEST_COMPOUND = 75
#: Phrases that are broadcast.
MOST_PHRASES = 1 << 16


def look_up(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """tokens joined with the lexicon's rows for the word, and, if it is not in lower case, with those for its lower-cased form after them.

    Adds lower_case (whether the row comes from the lower-cased form) and the lexicon's columns but ``form``; tokens without a row stay, with nulls.
    """
    forms = joins.form_counts(tokens, form_asked=F.col(word))
    more = [c for c in lexicon.columns if c != "form"]
    asked = F.array_distinct(F.array(F.struct(F.col("form_asked").alias("form"), F.lit(False).alias("lower_case")), F.struct(F.lower("form_asked").alias("form"), (F.lower("form_asked") != F.col("form_asked")).alias("lower_case"))))
    asked = forms.select("form_asked", "n", F.explode(asked).alias("a")).select("form_asked", "n", "a.form", "a.lower_case").join(lexicon, "form")
    found = asked.groupBy("form_asked", "n").agg(F.collect_list(F.struct("lower_case", *more)).alias("form_found"))
    own = joins.by_form(tokens.withColumn("form_asked", F.col(word)), found, ["form_asked"], ["form_found"])
    return own.withColumn("form_found", F.explode_outer("form_found")).select(*tokens.columns, "form_found.lower_case", *[F.col(f"form_found.{c}") for c in more])


def readings(tokens: DataFrame, lexicon: DataFrame, least_precision: float = 0.66, keep: str = "max", epsilon: float = 0.1, word: str = "word", msd: str = "msd") -> DataFrame:
    """The lexicon's readings of each token with their precision, normalised to sum 1 for a token.

    lexicon: form, reading, tags (array). Readings below ``least_precision`` go. keep: none of them is left out ("none"), only the best stays
    ("first"), or those within epsilon of it ("max"). Tokens without readings are left out. Key: doc_id, idx.
    """
    found = look_up(tokens, lexicon, word).where("reading is not null")
    found = found.withColumn("precision", reading_precision(F.col(msd), F.col("tags"))).where(F.col("precision") >= least_precision)
    token = Window.partitionBy("doc_id", "idx")
    order = token.orderBy(F.desc("precision"), "lower_case", "reading")
    found = found.withColumns({"score": F.col("precision") / F.sum("precision").over(token), "place": F.row_number().over(order)})
    found = found.withColumn("best", F.max("score").over(token))
    if keep == "first":
        found = found.where("place = 1")
    elif keep == "max":
        found = found.where(F.col("score") >= F.col("best") - epsilon)
    return found.drop("best", "lower_case")


def fallback(tokens: DataFrame, column: str, *lexicons: DataFrame, word: str = "word") -> DataFrame:
    """tokens whose empty set ``column`` is filled from the first lexicon (form, values) that has the word."""
    out = joins.form_counts(tokens, form_asked=F.lower(word))
    for i, lexicon in enumerate(lexicons):
        out = out.join(lexicon.select(F.col("form").alias("form_asked"), F.col("values").alias(f"values{i}")), "form_asked", "left")
    first = F.coalesce(*[F.when(F.size(f"values{i}") > 0, F.col(f"values{i}")) for i in range(len(lexicons))])
    known = out.select("form_asked", "n", first.alias("form_found")).where("form_found is not null")
    own = joins.by_form(tokens.withColumn("form_asked", F.lower(word)), known, ["form_asked"], ["form_found"])
    return own.withColumn(column, F.when(F.size(column) > 0, F.col(column)).otherwise(F.coalesce("form_found", column))).select(*tokens.columns)


def variants(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """tokens with variants, the sorted set of the lexicon's variants (form, variant) of the lower-cased word, itself not among them."""
    own = joins.form_counts(tokens, form_asked=F.lower(word)).join(lexicon.select(F.col("form").alias("form_asked"), "variant"), "form_asked")
    own = own.groupBy("form_asked", "n").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    out = joins.by_form(tokens.withColumn("form_asked", F.lower(word)), own, ["form_asked"], ["variants"])
    return out.select(*tokens.columns, F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda v: v != F.lower(word)).alias("variants"))


def linked(tokens: DataFrame, lexicon: DataFrame, column: str, name: str) -> DataFrame:
    """tokens with ``name``, the sorted set of what a lexicon (form, value) gives for the members of a set column."""
    sets = joins.form_counts(tokens, set_asked=F.col(column))
    known = sets.select("set_asked", "n", F.explode("set_asked").alias("form")).join(lexicon, "form").groupBy("set_asked", "n").agg(F.array_sort(F.collect_set("value")).alias(name))
    out = joins.by_form(tokens.withColumn("set_asked", F.col(column)), known, ["set_asked"], [name])
    return out.select(*tokens.columns, F.coalesce(name, F.array().cast("array<string>")).alias(name))


def homograph_sets(tokens: DataFrame, mapping: DataFrame, key: str = "idx", column: str = "lemgrams") -> DataFrame:
    """tokens with pos, the sorted set of the tags that a mapping (pos, tags) gives for the parts of speech in lemgrams, which stand after the two full stops; those of fragments and compounds (e, sxc, mxc) have none.

    key: what tells tokens apart. Tokens without lemgrams, or with none that is known, have the empty set.
    """
    kinds = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.regexp_extract(v, r"\.\.(.*?)\.", 1)), lambda k: ~k.isin("", "e", "sxc", "mxc"))
    known = tokens.select(F.col(key).alias("h_key"), F.explode(F.array_distinct(kinds)).alias("pos")).join(mapping, "pos")
    found = known.groupBy("h_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("pos"))
    return tokens.join(found, F.col(key) == F.col("h_key"), "left").select(*tokens.columns, F.coalesce("pos", F.array().cast("array<string>")).alias("pos"))


def sentiment(tokens: DataFrame, lexicon: DataFrame, senses: str = "senses") -> DataFrame:
    """tokens with sentiment_score and sentiment_label of their best-scored sense (``sense:score`` members; without a score -1).

    lexicon: sense, score. Labels are positive, neutral or negative by the score's whole part.
    """
    scored = F.transform(senses, lambda v, i: F.struct(F.when(v.contains(":"), F.substring_index(v, ":", -1).cast("double")).otherwise(-1.0).alias("score"), (-i).alias("place"), F.substring_index(v, ":", 1).alias("sense")))
    own = tokens.withColumn("best_sense", F.array_max(scored)["sense"])
    out = own.join(lexicon.select(F.col("sense").alias("best_sense"), F.col("score").alias("sentiment_score")), "best_sense", "left")
    whole = F.col("sentiment_score").cast("int")
    return out.select(*tokens.columns, "sentiment_score", F.when(whole > 0, "positive").when(whole < 0, "negative").when(whole == 0, "neutral").otherwise("").alias("sentiment_label"))


def token_classes(tokens: DataFrame, lexicon: DataFrame, senses: str = "senses", allowed_pos: tuple[str, ...] = ("NN", "VB", "JJ", "AB"), disambiguate: bool = True) -> DataFrame:
    """tokens with classes, the sorted set of the lexicon's (sense, class) classes of their best senses.

    Only tokens of the allowed parts of speech have any. With disambiguate only the last of the best-scored senses counts.
    """
    members = F.transform(senses, lambda v, i: F.struct(F.when(v.contains(":"), F.substring_index(v, ":", -1).cast("double")).otherwise(-1.0).alias("score"), i.alias("place"), F.substring_index(v, ":", 1).alias("sense")))
    chosen = F.array_compact(F.array(F.array_max(members)["sense"])) if disambiguate else F.transform(members, lambda m: m["sense"])
    sets = joins.form_counts(tokens.where(F.col("pos").isin(*allowed_pos)), set_asked=chosen)
    known = sets.select("set_asked", "n", F.explode("set_asked").alias("sense")).join(lexicon, "sense").groupBy("set_asked", "n").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    out = joins.by_form(tokens.withColumn("set_asked", F.when(F.col("pos").isin(*allowed_pos), chosen)), known, ["set_asked"], ["classes"])
    return out.select(*tokens.columns, F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def class_counts(tokens: DataFrame, keys: list[str], by_types: bool = False) -> DataFrame:
    """(keys..., class, n): how many tokens of a text have a class, and under a null class how many it has; by_types: different words in place of tokens. One grouping for both."""
    own = tokens.select(*keys, "word", F.explode(F.concat(F.array_distinct("classes") if by_types else F.col("classes"), F.array(F.lit(None).cast("string")))).alias("class"))
    if by_types:
        own = own.distinct()
    return own.groupBy(*keys, "class").agg(F.count("*").alias("n"))


def class_shares(counts: DataFrame) -> DataFrame:
    """(class, freq): the share of all tokens that have a class, from class_counts()."""
    total = counts.agg(F.sum(F.when(F.col("class").isNull(), F.col("n")))).scalar()
    return counts.where("class is not null").groupBy("class").agg(F.sum("n").alias("n")).select("class", (F.col("n") / total).alias("freq"))


def dominant_classes(counts: DataFrame, reference: DataFrame, keys: list[str], cutoff: int = 3) -> DataFrame:
    """text_classes() of class_counts()."""
    total = F.max(F.when(F.col("class").isNull(), F.col("n"))).over(Window.partitionBy(*keys))
    own = counts.withColumn("total", total).where("class is not null")
    shares = own.join(reference, "class").withColumn("dominance", F.col("n") / F.col("total") / F.col("freq")).where("dominance >= 1")
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("dominance")))
    return shares.withColumn("place", place).where(F.col("place") <= cutoff).select(*keys, "class", "dominance", "place")


def text_classes(tokens: DataFrame, reference: DataFrame, keys: list[str], cutoff: int = 3, by_types: bool = False, senses: str = "senses") -> DataFrame:
    """(keys..., class, dominance, place): a text's classes that are relatively more frequent than in the reference (class, freq), the ``cutoff`` first with ties.

    by_types: a word form's class counts once. Classes of which the reference knows nothing are left out.
    """
    return dominant_classes(class_counts(tokens, keys, by_types), reference, keys, cutoff)


def places(names: DataFrame, gazetteer: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """(keys..., places): for each key the sorted set of ``name;country;lat;lon`` of its names' most populous places.

    gazetteer: name, country, lat, lon, population; names compare in lower case, without white space around.
    """
    best = gazetteer.groupBy(F.lower("name").alias("g_name")).agg(F.max_by(F.concat_ws(";", "name", "country", F.col("lat").cast("string"), F.col("lon").cast("string")), F.struct("population", "name", "country")).alias("place"))
    hits = names.select(*keys, F.lower(F.trim(name)).alias("g_name")).distinct().join(best, "g_name")
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_set("place")).alias("places"))


def multiwords(tokens: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("doc_id", "sentence"), word: str = "word") -> DataFrame:
    """(keys..., first, last, reading): where a lexicon's (form, reading) phrases stand, words of a form being joined by one space.

    Every phrase is found by its first word and confirmed by the words that follow in the sentence; longest first, with what a longer one covers left out.
    """
    line = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.lower(word).alias("w")))), lambda x: x["w"])
    return multiwords_in_lines(tokens.groupBy(*keys).agg(line.alias("line"), F.min("idx").alias("base")), lexicon, keys)


def _looked_up(sentences: DataFrame, entries: list[tuple[tuple[str, ...], str]], keys: tuple[str, ...]) -> DataFrame:
    """(keys..., first, last, reading): all places of the entries in sentences (keys..., base, line); only words that open one are looked at."""
    kinds = dict(sentences.dtypes)
    held = sentences.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_opening: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for words, reading in held.value:
            by_opening.setdefault(words[0], []).append((words, reading))
        openings = pa.array(list(by_opening), pa.string())
        for batch in batches:
            line = batch.column("line")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(line), 0).to_numpy(zero_copy_only=False))
            flat = line.flatten()
            places = np.flatnonzero(pc.is_in(flat, openings).to_numpy(zero_copy_only=False)) if len(openings) else np.zeros(0, np.int64)
            rows = np.searchsorted(ends, places, "right")
            starts = ends - np.diff(ends, prepend=0)
            text = flat.to_pylist() if len(places) else []
            row, at, size, reading = [], [], [], []
            for place, r, end in zip(places.tolist(), rows.tolist(), ends[rows].tolist(), strict=True):
                for words, value in by_opening[text[place]]:
                    n = len(words)
                    if place + n <= end and text[place + 1] == words[1] and tuple(text[place : place + n]) == words:
                        row.append(r)
                        at.append(place)
                        size.append(n)
                        reading.append(value)
            which = np.array(row, np.int64)
            first = batch.column("base").take(pa.array(which)).to_numpy(zero_copy_only=False).astype(np.int64) + np.array(at, np.int64) - starts[which]
            of_keys = [batch.column(k).take(pa.array(which)) for k in keys]
            yield pa.RecordBatch.from_arrays([*of_keys, *(pa.array(x).cast(batch.column("base").type) for x in (first, first + np.array(size, np.int64) - 1)), pa.array(reading, pa.string())], [*keys, "first", "last", "reading"])

    return sentences.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"first {kinds['base']}, last {kinds['base']}, reading string"]))


def multiwords_in_lines(sentences: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("doc_id", "sentence")) -> DataFrame:
    """As multiwords(), of (keys..., base, line): a row a sentence with its words in lower case and the idx of the first, as segmentation.token_lines() gathers them without an exchange."""
    entries = lexicon.select(F.split(F.lower("form"), " ").alias("words"), "reading").where(F.size("words") > 1)
    some = entries.limit(MOST_PHRASES + 1).collect()
    if len(some) <= MOST_PHRASES:
        found = _looked_up(sentences.select(*keys, "base", "line"), [(tuple(r["words"]), r["reading"]) for r in some], keys)
    else:
        starts = sentences.select(*keys, "base", F.posexplode("line").alias("at", "opening"), "line").join(entries.withColumn("opening", F.get("words", F.lit(0))), "opening")
        found = starts.where(F.slice("line", F.col("at") + 1, F.size("words")) == F.col("words"))
        found = found.select(*keys, (F.col("base") + F.col("at")).alias("first"), (F.col("base") + F.col("at") + F.size("words") - 1).alias("last"), "reading")
    furthest = F.max("last").over(Window.partitionBy(*keys).orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    return found.withColumn("covered", furthest).withColumn("longest", F.max("last").over(Window.partitionBy(*keys, "first"))).where("last = longest and (covered is null or last > covered)").drop("covered", "longest")


def gapped_multiwords(tokens: DataFrame, lexicon: DataFrame, most_gaps: int = 1, keys: tuple[str, ...] = ("doc_id", "sentence"), word: str = "word", msd: str = "pos", check_tags: bool = True) -> DataFrame:
    """(keys..., places, reading): where a lexicon's phrases stand, with other words between theirs where they allow it.

    lexicon: words (array, lower case; * where a gap may be), reading, gaps, particle. Each sentence walks the phrases' trie once. With check_tags readings with ..vbm. need a verb among
    their words, ..nnm. a noun, and a particle phrase does not end in a preposition. Of two phrases of one part of speech that cross (b a b a), or end together without one holding the
    other, the one that ends later, or begins earlier, goes. places: idx of the words.
    """
    none = F.array().cast("array<string>")
    trie = phrases.phrase_trie(lexicon.select("words", none.alias("baseforms"), F.array("reading").alias("lemgrams"), none.alias("senses"), "gaps", "particle"))
    found = phrases.phrase_places(tokens, trie, keys=keys, word=word, msd=msd, most_gaps=most_gaps, check_tags=check_tags)
    return found.select(*keys, "places", F.get("lemgrams", F.lit(0)).alias("reading"))


def with_multiwords(tokens: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """tokens whose set ``column`` gets the readings of gapped_multiwords() that they are in: the first word the reading, the others the reading, a colon and the first word's idx."""
    value = F.when(F.col("at") == 0, F.col("reading")).otherwise(F.concat("reading", F.lit(":"), F.get("places", F.lit(0)).cast("string")))
    more = found.select("doc_id", "places", "reading", F.posexplode("places").alias("at", "idx")).groupBy(F.col("doc_id").alias("m_doc"), F.col("idx").alias("m_idx")).agg(F.array_sort(F.collect_list(value)).alias("more"))
    out = tokens.join(more, (F.col("doc_id") == F.col("m_doc")) & (F.col("idx") == F.col("m_idx")), "left")
    none = F.array().cast("array<string>")
    return out.withColumn(column, F.concat(F.coalesce(column, none), F.coalesce("more", none))).select(*tokens.columns)


def compounds(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, parts, score): the best split of each different word into the lexicon's parts; words without one are left out.

    lexicon: part, role (prefix, infix, suffix, or any), probability. Fewest parts first, then the largest product of probabilities, then the parts in order. Of three
    equal consonants where parts meet one is written, so it counts for both. The lexicon is joined by the substrings of
    each word, so that no task holds it. Parts have two letters or more, and there may be any number of them; words of more than LONGEST_COMPOUND letters are left out.
    """
    consonants = "bcdfghjklmnpqrstvwxz"
    own = words.select(F.lower(word).alias("word")).where(F.length("word").between(3, LONGEST_COMPOUND)).distinct()
    pieces = own.withColumn("a", F.explode(F.sequence(F.lit(0), F.length("word") - 2))).withColumn("b", F.explode(F.sequence(F.col("a") + 2, F.length("word"))))
    pieces = pieces.withColumn("text", F.expr("substring(word, a + 1, b - a)"))
    doubled = F.col("text").substr(-1, 1)
    pieces = pieces.select("word", "a", "b", F.explode(F.when(doubled.isin(*consonants) & (F.col("text").substr(-2, 1) == doubled) & (F.col("b") < F.length("word")), F.array(F.struct(F.col("text").alias("part"), F.lit(0).alias("back")), F.struct(F.col("text").alias("part"), F.lit(1).alias("back")))).otherwise(F.array(F.struct(F.col("text").alias("part"), F.lit(0).alias("back"))))).alias("p")).select("word", "a", "b", "p.part", "p.back")
    hits = pieces.join(lexicon, "part").groupBy("word").agg(F.collect_list(F.struct("a", (F.col("b") - F.col("back")).alias("b"), "part", "role", "probability")).alias("hits"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text, found in zip(frame["word"], frame["hits"], strict=True):
                by_start: dict[int, list] = {}
                for h in found:
                    by_start.setdefault(h["a"], []).append(h)
                level, done = {0: (-1.0, ())}, []
                while level and not done:  # one part more at a time; of all ways to a place only the best goes on
                    grown: dict[int, tuple] = {}
                    for at, (p, parts) in level.items():
                        for h in by_start.get(at, ()):
                            end = h["b"] >= len(text)
                            need = "suffix" if end else "prefix" if not parts else "infix"
                            if h["role"] in (need, "any") and (parts or not end) and h["b"] > at:
                                way = (p * h["probability"], (*parts, h["part"]))
                                if end:
                                    done.append(way)
                                elif h["b"] not in grown or way < grown[h["b"]]:
                                    grown[h["b"]] = way
                    level = grown
                if done:
                    score, parts = min(done)
                    rows.append((text, list(parts), -score))
            yield pd.DataFrame(rows, columns=["word", "parts", "score"])

    return hits.mapInPandas(best, "word string, parts array<string>, score double")


def tag_by_lexicon(tokens: DataFrame, lexicon: DataFrame, word: str = "word", default: Column | None = None) -> DataFrame:
    """tokens with msd: the lexicon's (form, msd) most frequent tag of the word or its lower-cased form, else one by its shape.

    A deterministic stand-in for taggers that are programs of their own: tokens of digits are RG.NOM, of punctuation MAD or MID, capitalised ones PM.NOM, others NN.
    """
    shape = F.when(F.col(word).rlike(r"^[.!?]+$"), "MAD").when(F.col(word).rlike(r"^[^\p{L}\p{N}]+$"), "MID").when(F.col(word).rlike(r"^\p{N}+$"), "RG.NOM").when(F.col(word).rlike(r"^\p{Lu}"), "PM.NOM").otherwise("NN")
    best = look_up(joins.form_counts(tokens, t_word=F.col(word)), lexicon, "t_word").groupBy("t_word", "n").agg(F.max_by("msd", F.struct((~F.col("lower_case")).alias("exact"), "msd")).alias("t_msd"))
    out = joins.by_form(tokens.withColumn("t_word", F.col(word)), best, ["t_word"], ["t_msd"])
    return out.select(*tokens.columns, F.coalesce("t_msd", default if default is not None else shape).alias("msd"))
