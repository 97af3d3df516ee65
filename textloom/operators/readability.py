"""Readability measures of texts or other chunks of tokens: grouped aggregates, raw doubles. format_number() writes them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = ("MAD", "MID", "PAD")




def lix(tokens: DataFrame, keys: list[str], sentence: str, word: str = "word", pos: str | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Words per sentence and 100 times the share of words of more than six characters.

    Every sentence counts, also one whose words are all skipped. nan without words and sentences, inf if only one of them is missing.
    """
    use = ~F.col(pos).isin(*skipped) if pos else F.lit(True)
    out = tokens.groupBy(*keys).agg(F.count_if(use & F.col(word).isNotNull()).alias("words"), F.count_distinct(sentence).alias("sentences"), F.count_if(use & (F.length(word) > 6)).alias("long"))
    w, s = F.col("words"), F.col("sentences")
    value = F.when((w == 0) & (s == 0), float("nan")).when((w == 0) | (s == 0), float("inf")).otherwise(w / s + 100 * F.col("long") / w)
    return out.select(*keys, value.alias("lix"))


def ovix(tokens: DataFrame, keys: list[str], word: str = "word", pos: str | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Variation of words: log(n) / log(2 - log(types) / log(n)), lower-cased; nan without words, inf if none repeats."""
    use = ~F.col(pos).isin(*skipped) if pos else F.lit(True)
    own = F.when(use, F.lower(word))
    out = tokens.groupBy(*keys).agg(F.count(own).alias("n"), F.count_distinct(own).alias("types"))
    n, types = F.col("n"), F.col("types")
    value = F.when(n == 0, float("nan")).when(n == types, float("inf")).otherwise(F.log(n) / F.log(2 - F.log(types) / F.log(n)))
    return out.select(*keys, value.alias("ovix"))


def nominal_ratio(tokens: DataFrame, keys: list[str], pos: str, nominal: tuple[str, ...] = ("NN", "PP", "PC"), verbal: tuple[str, ...] = ("PN", "AB", "VB")) -> DataFrame:
    """Nominal by verbal words; inf without verbal ones."""
    out = tokens.groupBy(*keys).agg(F.count_if(F.col(pos).isin(*nominal)).alias("n"), F.count_if(F.col(pos).isin(*verbal)).alias("v"))
    return out.select(*keys, F.when(F.col("v") == 0, float("inf")).otherwise(F.col("n") / F.col("v")).alias("nominal_ratio"))


def format_number(value: Column, decimals: int = 2) -> Column:
    """A double as text, rounded as the exact binary value; nan and inf in lower case."""

    @F.pandas_udf("string")
    def shown(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda v: f"{v:.{decimals}f}")

    return shown(value)
