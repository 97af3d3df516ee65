"""From raw documents to token ids: filter, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. ``docs`` has the columns
of ``documents``, as has what all stages but the last return; other columns are left out. Ids are taken to be unique in what comes in, but rows with one id are
handled as the operators do: equal rows stay or go together. Rows with a null id take part in what needs no id; null texts are empty. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, fm_dedup, minhash, mixing, quality
from textloom.llm.common import written

#: Documents below this score go. It lies under the even chance so that doubtful documents stay.
LEAST_QUALITY = 0.35
RANKS = "byte_bpe_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with quality_score by a classifier that learns from the labels outside its held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return quality.quality_scores(docs, weights)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    docs = docs.select(*COLUMNS)
    return _scored(spark, docs, sf_dir).where(F.col("quality_score") >= LEAST_QUALITY).drop("quality_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8."""
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; documents without a word left go."""
    docs = docs.select(*COLUMNS)
    cut = fm_dedup.substring_dedup(docs).where("kept is not null").select(F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest"), F.col("kept").cast("string").alias("kept"))
    cut = cut.dropDuplicates(["cut_id", "cut_digest"])  # equal rows
    out = docs.join(cut, (docs["doc_id"] == cut["cut_id"]) & (F.xxhash64(docs["text"]) == cut["cut_digest"]), "left").where("kept is null or kept <> ''")
    changed = {"text": F.coalesce("kept", "text"), "n_chars": F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long"))}
    return out.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; its weight is the score of a classifier of what is left."""
    docs = docs.select(*COLUMNS)
    scored = written(_scored(spark, docs, sf_dir), "scored")
    times = mixing.mixed(scored, weight=scored["quality_score"]).where(F.col("mix_times") > 0)
    return times.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, decoded_sha256)."""
    with open(public_tokenizers.path(RANKS), "rb") as file:
        ranks = file.read()
    return bpe.with_token_ids(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
