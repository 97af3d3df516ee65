"""Collocations: phrases of 2 to max_n words that are more frequent than their parts let expect, for each language.

Texts are ASCII-lower-cased and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words ``[^\\x20\\x09]+``. Every place of a word becomes a row
with the word after it in the same piece, and one aggregation counts words of a language, words and pairs. A phrase that is frequent enough holds only
pairs that are, so longer phrases are exploded from places of frequent pairs alone; nothing that could be a candidate is left out.
The frequent pairs' hashes filter the places: broadcast up to BROADCAST_ROWS of them, joined beyond that. A hash that meets another one lets a rare phrase in, which its count puts out again.

Scores are exact: products of 38 digits and an integral division. A lowest-scoring cut takes the counts of both parts by joins on (language, phrase); one-word
extensions decide what stands inside a longer candidate, for a longer one still has a one-word extension that is at least as frequent.

Null texts are empty; a null language is ``und``. Repeated rows count as often as they stand there, rows with null or equal ids too: ids are not used. Other columns are not read.
Ties of score and count go by the phrase's bytes. An empty table gives an empty result. The words of one document are in one task's memory, some 100 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import broadcast_within, written

MAX_N = 5
LEAST_COUNT = 100
#: A candidate goes if a longer one has this share of its count, in hundredths.
INSIDE = 100
TOP = 2000
#: Hashes of frequent pairs (8 bytes each) that every task may hold.
BROADCAST_ROWS = 1 << 20
#: Parts that each language's candidates are ranked in first.
PARTS = 64
SEPARATORS = ".,;:!?\n\x0b\x0c\r"


def words_and_breaks(text: Column) -> Column:
    """The words in order; a line feed stands wherever a piece ends."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(F.coalesce(text, F.lit("")), upper + SEPARATORS + "\t", lower + "\n" * len(SEPARATORS) + " ")
    return F.split(F.trim(F.replace(plain, F.lit("\n"), F.lit(" \n "))), " +")


def places(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, doc, pos, first, second): each word with the next one of its piece, or null. Breaks count as positions."""
    own = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.monotonically_increasing_id().alias("doc"), words_and_breaks(F.col(text_column)).alias("words"))
    after = F.slice("words", 2, F.size("words"))
    own = own.select("lang", "doc", F.posexplode(F.arrays_zip(F.col("words").alias("first"), after.alias("second"))).alias("pos", "w"))
    return own.select("lang", "doc", "pos", "w.first", F.when(F.col("w.second") != "\n", F.col("w.second")).alias("second")).where(~F.col("first").isin("\n", ""))


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST_COUNT, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, total), (lang, n, phrase, f)): all words of a language, and its phrases of up to max_n words with f >= least."""
    rows = places(docs, text_column, lang_column)
    grouped = rows.groupingSets([["lang"], ["lang", "first"], ["lang", "first", "second"]], "lang", "first", "second")
    counts = grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("f")).where((F.col("level") == 3) | (F.col("f") >= least) & ((F.col("level") == 1) | F.col("second").isNotNull()))
    counts = written(counts, "phrase-counts")  # level 3: language; 1: word; 0: pair
    totals = counts.where("level = 3").select("lang", F.col("f").alias("total"))
    words = counts.where("level = 1 and f >= %d" % least).select("lang", F.lit(1).alias("n"), F.col("first").alias("phrase"), "f")
    pairs = counts.where("level = 0")
    short = words.unionByName(pairs.select("lang", F.lit(2).alias("n"), F.concat_ws(" ", "first", "second").alias("phrase"), "f"))
    if max_n < 3:
        return totals, short
    gram = F.xxhash64("lang", "first", "second")
    frequent = broadcast_within(pairs.select(gram.alias("gram")).distinct(), BROADCAST_ROWS)
    runs = rows.where("second is not null").withColumn("gram", gram).join(frequent, "gram", "left_semi")
    here = Window.partitionBy("doc").orderBy("pos")
    leads = {f"next{j}": F.when(F.lead("pos", j).over(here) == F.col("pos") + j, F.lead("second", j).over(here)) for j in range(1, max_n - 1)}
    runs = runs.withColumns(leads).where("next1 is not null")
    phrase, longer = F.concat(F.col("first"), F.lit(" "), F.col("second")), []
    for j in range(1, max_n - 1):
        phrase = F.concat(phrase, F.lit(" "), F.col(f"next{j}"))  # null from the first gap on
        longer.append(F.struct(F.lit(j + 2).alias("n"), phrase.alias("phrase")))
    longer = runs.select("lang", F.explode(F.array(*longer)).alias("p")).where("p.phrase is not null")
    longer = longer.groupBy("lang", F.col("p.n").alias("n"), F.col("p.phrase").alias("phrase")).agg(F.count("*").alias("f")).where(F.col("f") >= least)
    return totals, short.unionByName(longer)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST_COUNT, inside: int = INSIDE, top: int = TOP, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations.

    a: the phrase's count; l and r: those of the two parts of its lowest-scoring cut; n: words of the language; score: floor(1000 a n / (l r)).
    """
    totals, counts = phrase_counts(docs, max_n, least, text_column, lang_column)
    counts = written(counts, "phrases")
    candidates = counts.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    # One-word extensions: what is left of a longer candidate without its first or its last word.
    ends = [F.slice("words", i, F.size("words") - 1) for i in (1, 2)]
    extended = candidates.where("size(words) > 2").select("lang", F.explode(F.array(*[F.array_join(x, " ") for x in ends])).alias("phrase"), (F.col("a") * 100).alias("longer"))
    extended = extended.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    candidates = candidates.join(extended, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a") * inside)).drop("longer")

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "words", cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    parts = counts.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(broadcast_within(totals.withColumnRenamed("total", "n"), 1 << 16), "lang")
    exact = {c: f"cast({c} as decimal(18, 0))" for c in "alrn"}
    score = F.expr(f"(1000 * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = scored.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
