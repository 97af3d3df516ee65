"""Builders of the lexicon tables that other operators join: from XML lexicons, tab-separated lists and corpora.

Inputs are tables of what was downloaded elsewhere; nothing is fetched here.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "form string, baseform string, lemma string, sense string, pos string, inherent array<string>, tag string, params string, paradigm string"


def lexicon_entries(contents: DataFrame) -> DataFrame:
    """A row for each word form of each entry of XML lexicons in the lexical mark-up framework (content, one file a row).

    Features are read from feat elements (att, val): of the lemma writtenForm, lemgram, partOfSpeech, inherent, paradigm; of word forms writtenForm, msd,
    param; of senses their id. An entry without a sense has ''.
    """
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def features(element: ET.Element | None) -> dict[str, str]:
        return {f.get("att", ""): f.get("val", "") for f in element.iter("feat")} if element is not None else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for entry in ET.fromstring(content).iter("LexicalEntry"):
                    lemma, senses = features(entry.find("Lemma")), [s.get("id", "") for s in entry.iter("Sense")]
                    for form in entry.iter("WordForm"):
                        own = features(form)
                        rows += [(own.get("writtenForm", ""), lemma.get("writtenForm", ""), lemma.get("lemgram", ""), s, lemma.get("partOfSpeech", ""), lemma.get("inherent", "").split(), own.get("msd", ""), own.get("param", own.get("msd", "")), lemma.get("paradigm", "")) for s in senses or [""]]
                kinds = [pa.string()] * 5 + [pa.list_(pa.string())] + [pa.string()] * 3
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return contents.select(F.col("content").cast("binary").alias("content")).mapInArrow(run, ENTRY)


def word_lexicon(entries: DataFrame, tag_map: DataFrame, left_out: tuple[str, ...] = ("frag", "c", "ci", "cm")) -> DataFrame:
    """(form, reading, baseform, sense, tags): single words by reading, with the tags that a map (pos, tag, msd) gives for their forms.

    Forms with a tag of ``left_out`` (parts of compounds and fragments) go, as do forms of several words; those are phrase_lexicon()'s.
    """
    own = entries.where(~F.col("tag").isin(*left_out) & ~F.col("form").contains(" "))
    return own.join(tag_map, ["pos", "tag"], "left").groupBy("form", F.col("lemma").alias("reading"), "baseform", "sense").agg(F.array_sort(F.collect_set("msd")).alias("tags"))


#: How a tag was resolved, by level.
LEVELS = ("exact", "gender", "part of speech", "all of it", "lemgram")


def resolved_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """(tag, level, msds): of each different tag what a many-to-many mapping (tag, msd) has for it, by the first level that has something.

    Levels: the tag itself; with masculine or feminine (m, f between others) as common gender (u); its part of speech (the first word) alone; all tags with that part of speech. A tag that none of them has
    gets the level null and no msds. Masculine counts before feminine.
    """
    own = tags.select("tag").where("tag is not null").distinct()
    pos = F.substring_index("tag", " ", 1)
    asked = F.array(*[
        F.struct(F.lit(level).alias("level"), key.alias("key"))
        for level, key in ((0, F.col("tag")), (1, F.replace("tag", F.lit(" m "), F.lit(" u "))), (2, F.replace("tag", F.lit(" f "), F.lit(" u "))), (3, pos), (4, F.concat(F.lit("* "), pos)))
    ])
    keys = mapping.select(F.col("tag").alias("key"), "msd").unionByName(mapping.select(F.concat(F.lit("* "), pos).alias("key"), "msd")).distinct()
    found = own.select("tag", F.explode(asked).alias("a")).select("tag", "a.level", "a.key").join(keys, "key").groupBy("tag", "level").agg(F.array_sort(F.collect_set("msd")).alias("msds"))
    best = found.groupBy("tag").agg(F.min(F.struct("level", "msds")).alias("b")).select(F.col("tag").alias("b_tag"), "b.level", "b.msds")
    name = F.get(F.array(*[F.lit(LEVELS[i]) for i in (0, 1, 1, 2, 3)]), F.col("level"))
    return own.join(best, F.col("tag") == F.col("b_tag"), "left").select("tag", name.alias("level"), F.coalesce("msds", F.array().cast("array<string>")).alias("msds"))


def historical_lexicon(entries: DataFrame, mapping: DataFrame, fallback: DataFrame | None = None, translate: bool = True) -> tuple[DataFrame, DataFrame]:
    """((form, reading, baseform, tags, level), (words, reading, baseform)): words and phrases of a lexicon of an older language.

    entries: form, lemma, baseform, pos, inherent (array; "-" is none), tag. Forms of several words are phrases, without gaps or particles. Tags are resolved as resolved_tags() does it, each different one once; where
    that gives nothing, by the part of speech in the lemma's name (``..nn.``) if ``fallback`` (pos, tags) is given. Words without a tag are left out. Without translate a tag is the part of speech and the form's tag.
    """
    inherent = F.filter("inherent", lambda i: ~i.isin("-", ""))
    own = entries.withColumn("words", F.filter(F.split(F.trim("form"), r"\s+"), lambda w: w != "")).withColumn("tag", F.array_join(F.concat(F.array("pos"), inherent if translate else F.array().cast("array<string>"), F.array("tag")), " "))
    phrases_ = own.where("size(words) > 1").select("words", F.col("lemma").alias("reading"), "baseform").distinct()
    single = own.where("size(words) = 1").select(F.get("words", F.lit(0)).alias("form"), F.col("lemma").alias("reading"), "baseform", "tag")
    if translate:
        found = resolved_tags(single, mapping)
        single = single.join(found.select(F.col("tag").alias("r_tag"), "level", "msds"), F.col("tag") == F.col("r_tag"), "left")
    else:
        single = single.withColumns({"level": F.lit(LEVELS[0]), "msds": F.array("tag")})
    if fallback is not None:
        kind = F.regexp_extract("reading", r"\.\.(.*?)\.", 1)
        single = single.join(fallback.select(F.col("pos").alias("l_pos"), F.col("tags").alias("l_tags")), kind == F.col("l_pos"), "left")
        empty = F.coalesce(F.size("msds") == 0, F.lit(True)) & F.col("l_tags").isNotNull()
        single = single.withColumns({"level": F.when(empty, LEVELS[4]).otherwise(F.col("level")), "msds": F.when(empty, F.col("l_tags")).otherwise(F.col("msds"))})
    words = single.where("size(msds) > 0").groupBy("form", "reading", "baseform").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("msds")))).alias("tags"), F.array_sort(F.collect_set("level")).alias("levels"))
    return words, phrases_


def phrase_lexicon(entries: DataFrame) -> DataFrame:
    """(form, reading): forms of several words, for multiwords()."""
    return entries.where(F.col("form").contains(" ")).select("form", F.col("lemma").alias("reading")).distinct()


def compound_lexicon(entries: DataFrame) -> DataFrame:
    """(part, reading, params): what a form can be in a compound, by reading."""
    return entries.groupBy(F.col("form").alias("part"), F.col("lemma").alias("reading")).agg(F.array_sort(F.collect_set("tag")).alias("params"))


def tag_table(lexicon: DataFrame, known: DataFrame, proper: str = "PM") -> DataFrame:
    """(form, tags): a tagger's table of a word lexicon's forms and their capitalised ones, but for words that ``known`` (form) has already.

    A lower-cased form that is known keeps all but proper names out. Tags with a gap (-) go.
    """
    single = lexicon.select("form", F.explode("tags").alias("msd")).where(~F.col("msd").contains("-"))
    both = single.unionByName(single.select(F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)")).alias("form"), "msd"))
    out = both.join(known.select("form"), "form", "left_anti")
    lower = known.select(F.lower("form").alias("low")).distinct()
    out = out.join(lower, (F.lower("form") == F.col("low")) & ~F.col("msd").startswith(proper), "left_anti")
    return out.groupBy("form").agg(F.array_sort(F.collect_set("msd")).alias("tags"))


def merged_tag_tables(*tables: DataFrame) -> DataFrame:
    """Tag tables (form, tags) as one."""
    out = tables[0].select("form", "tags")
    for t in tables[1:]:
        out = out.unionByName(t.select("form", "tags"))
    return out.groupBy("form").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def pivot_lexicon(links: DataFrame) -> DataFrame:
    """(form, value) from (form, value, kind, place): of each old word form the modern one of its last exact link."""
    return links.where(F.col("kind") == "exactMatch").groupBy("form").agg(F.max_by("value", "place").alias("value"))


def class_lexicon(senses: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(sense, level, class) from (sense, head) and (head, subsection, section, class): a sense's classes on all levels. A head without a class is an error."""
    own = senses.join(hierarchy, "head", "left").withColumn("class", F.coalesce("class", F.raise_error(F.concat(F.lit("no class for "), "head"))))
    levels = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("class")) for c in ("head", "subsection", "section", "class")])
    return own.select("sense", F.explode(levels).alias("l")).select("sense", "l.level", "l.class").distinct()


def sentiment_lexicon(lines: DataFrame) -> DataFrame:
    """(sense, score) from lines of a sense and its score between white space; comments begin with #, blank lines go. Of a sense that comes again the larger score counts."""
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    own = lines.where(~F.trim("line").startswith("#") & (F.trim("line") != "")).select(F.get(parts, F.lit(0)).alias("sense"), F.get(parts, F.lit(1)).cast("double").alias("score"))
    return own.groupBy("sense").agg(F.max("score").alias("score"))


def frame_lexicon(frames: DataFrame, prefix: str = "") -> DataFrame:
    """(sense, class) from (frame, senses): the frames of each sense, without the prefix of their names."""
    name = F.when(F.col("frame").startswith(prefix), F.expr(f"substring(frame, {len(prefix) + 1})")).otherwise(F.col("frame")) if prefix else F.col("frame")
    return frames.select(F.explode("senses").alias("sense"), name.alias("class")).distinct()


def class_frequencies(tokens: DataFrame, classes: DataFrame, smoothing: float = 0.1, times: str | None = None) -> DataFrame:
    """(class, freq): the smoothed relative frequencies of all classes in a reference corpus with the set column classes. times: the column that tells how many tokens a row stands for."""
    weight = F.col(times).cast("long") if times else F.lit(1)
    total = tokens.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    counts = tokens.select(F.explode("classes").alias("class"), weight.alias("w")).groupBy("class").agg(F.sum("w").alias("n"))
    every = classes.select("class").distinct()
    kinds = every.count()
    return every.join(counts, "class", "left").select("class", ((F.coalesce("n", F.lit(0)) + smoothing) / F.lit(float(total + smoothing * kinds) or 1.0)).alias("freq"))


def gazetteer(cities: DataFrame, other_names: DataFrame, languages: tuple[str, ...] = ()) -> DataFrame:
    """(name, known_as, country, lat, lon, population) from cities (id, name, country, lat, lon, population) and (id, language, other_name): a row a name in lower case.

    Other names count in the given languages, or in all if none is given.
    """
    other = other_names.where(F.col("language").isin(*languages)) if languages else other_names
    columns = ["name", "country", "lat", "lon", "population"]
    named = cities.select(F.lower("name").alias("known_as"), *columns)
    return named.unionByName(cities.join(other, "id").select(F.lower("other_name").alias("known_as"), *columns)).distinct()


def compound_model(compounds: DataFrame, gamma: float = 0.001) -> DataFrame:
    """(tag, n, probability) from (compound, tags): how probable a sequence of parts' tags is, smoothed, each compound counting once."""
    counts = compounds.distinct().groupBy(F.array_join("tags", "+").alias("tag")).agg(F.count("*").alias("n"))
    from textloom.operators.frequency import smoothed

    return smoothed(counts, "tag", "n", gamma)


def word_model(frequencies: DataFrame, gamma: float = 0.001) -> DataFrame:
    """(word, tag, n, probability) from (word, msd, freq): the smoothed probability of a word form with a simple tag (the first part of msd)."""
    counts = frequencies.groupBy("word", F.split("msd", r"\.")[0].alias("tag")).agg(F.sum("freq").alias("n"))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return counts.withColumn("probability", (F.col("n") + gamma) / F.lit(float(total + gamma * kinds) or 1.0))


def split_token_list(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(form): words that a tokenizer cuts, so that it is told to keep them. pieces: doc_id, idx of each word's tokens, doc_id being the word."""
    cut = pieces.groupBy(F.col("doc_id").alias("form")).agg(F.count("*").alias("n")).where("n > 1")
    return words.select("form").distinct().join(cut.select("form"), "form", "left_semi")

