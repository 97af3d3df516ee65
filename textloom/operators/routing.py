"""Which sentences a costly analysis gets: all of it, tags only, or nothing, by their sizes and longest tokens; and the three parts put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL, TAGS, NONE = "full", "tags", "none"


def routes(tokens: DataFrame, most_tokens: int = 5000, longest_sentence: int = 0, longest_token: int = 0, keys: tuple[str, ...] = ("doc_id", "sentence"), word: str = "word") -> DataFrame:
    """tokens with route, by sentence.

    A sentence of more than most_tokens tokens, or with a token of more than longest_token characters, gets nothing; one of more than longest_sentence tokens only tags; all others everything. 0: no limit
    (of the latter two). Tokens in no sentence (a null key) get tags only. A null word has no characters.
    """
    size = F.count("*").alias("r_size")
    longest = F.coalesce(F.max(F.length(word)), F.lit(0)).alias("r_longest")
    sizes = tokens.groupBy(*[F.col(k).alias(f"r_{k}") for k in keys]).agg(size, longest)
    sizes = sizes.where(" and ".join(f"r_{k} is not null" for k in keys))
    out = tokens.join(sizes, [F.col(k) == F.col(f"r_{k}") for k in keys], "left")
    return out.select(*tokens.columns, _route(F.col("r_size"), F.col("r_longest"), most_tokens, longest_sentence, longest_token).alias("route"))


def _route(size: Column, longest: Column, most_tokens: int, longest_sentence: int, longest_token: int) -> Column:
    """size: null for what is in no sentence."""
    nothing = size > most_tokens
    if longest_token:
        nothing = nothing | (longest > longest_token)
    route = F.when(size.isNull(), TAGS).when(nothing, NONE)
    return route.when(size > longest_sentence, TAGS).otherwise(FULL) if longest_sentence else route.otherwise(FULL)


def routed_lines(lines: DataFrame, analyses: dict[str, Callable[[Column, Column], dict[str, Column]]], most_tokens: int = 5000, longest_sentence: int = 0, longest_token: int = 0, key: str = "sentence") -> DataFrame:
    """(doc_id, idx, word, route, ...): the tokens of lines by the routes that routes() gives them, with what each route's analysis gives, null where it gives none.

    lines: doc_id, the key (null: in no sentence), first, words; a row a sentence with its words, as segmentation.token_lines() gathers them, so that nothing is shuffled and nothing made twice. An analysis is given a
    word and its place in the sentence, from 0.
    """
    longest = F.coalesce(F.array_max(F.transform("words", lambda w: F.length(w))), F.lit(0))
    own = lines.withColumn("route", _route(F.when(F.col(key).isNotNull(), F.size("words")), longest, most_tokens, longest_sentence, longest_token))
    own = own.select("doc_id", "first", "route", F.posexplode("words").alias("at", "word"))
    made = {route: analysis(F.col("word"), F.col("at")) for route, analysis in analyses.items()}
    columns = dict.fromkeys(c for m in made.values() for c in m)
    found = {c: F.coalesce(*[F.when(F.col("route") == route, m[c]) for route, m in made.items() if c in m]) for c in columns}
    return own.select("doc_id", (F.col("first") + F.col("at")).alias("idx"), "word", "route", *[v.alias(c) for c, v in found.items()])


def routed(tokens: DataFrame, analyses: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """What each route's analysis gives for its tokens, put together: the columns of all of them, null where a route's analysis gives none.

    tokens: with route. Tokens of a route without an analysis are kept as they are. An analysis gives a row a token with the columns it had, so the parts meet by position and no join is needed.
    """
    parts = [run(tokens.where(F.col("route") == route)) for route, run in analyses.items()]
    parts.append(tokens.where(F.col("route").isNull() | ~F.col("route").isin(*analyses)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
