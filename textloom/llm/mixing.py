"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u in (0, 1) from a digest of its id and gets the
exponential key -ln(u) / w, w its quality weight: the documents of a source in
the order of their keys are a weighted sample without replacement, however long
a prefix is taken. A source's target is met by complete epochs first; the rest
is the prefix of that order whose words fit, the last document being taken if
more than half of it fits.

No source is sorted in one task. Keys are dealt into ranges of their logarithm, the ranges' words
are summed up, and only the range in which a budget ends is sorted; it is
dealt again by finer ranges first, so that it is small. A weight only shifts the logarithm: the ranges are as fine for any weight.

Nulls: a null text has size 0; null sources are one source, the last; a null
weight or one that is not above 0 counts as the least weight. Rows with equal ids
have equal keys and are taken in the order of their sizes. An empty table gives an
empty result. Sources are few (their targets are found in one small window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

#: Ranges of the key for each doubling of it, and parts of a range.
RANGES, PARTS = 512, 2048
#: A source takes no more than so many epochs.
MOST_EPOCHS = 2.0
LEAST_WEIGHT = 0.05
#: Tables of sources are broadcast up to so many rows.
MOST_BROADCAST = 20_000


def n_words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """The share of letters of any script and of spaces in a text: a plain measure of how little mark-up and junk it holds."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]+", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(0.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The sources, by code point and null last, weigh ``weights`` in turn and share ``share`` of all words.
    A target above MOST_EPOCHS times its source is cut to that and the excess reshared by weight among
    the others until none is above: each target is then the smaller of that cap and weight * level.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    out = (
        sizes.withColumn("turn", F.row_number().over(turn) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(MOST_EPOCHS))
    )
    # In the order of cap / weight, sources are cut until the level of those left is below their own ratio.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    every, before = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left_over = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumns({"level": left_over / weight_left, "place": F.row_number().over(by_ratio)})
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct("place", "level"))).over(every)["level"]
    return out.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, size: Column | None = None, weight: Column | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, and mix_times: how often the mix holds the row.

    size: the words of a row, counted in its text if not given. weight: its quality weight. Columns of ``docs`` whose
    names begin with mix_ are replaced.
    """
    size = n_words(docs[text_column]) if size is None else size
    weight = quality_weight(docs[text_column]) if weight is None else weight
    columns = [c for c in docs.columns if not c.startswith("mix_")]
    digest = F.md5(F.coalesce(docs[id_column].cast("string"), F.lit("")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    w = F.greatest(F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    keyed = docs.withColumns({"mix_size": size, "mix_key": -F.log(u) / w})
    place = F.log2("mix_key") * RANGES
    keyed = keyed.withColumns({"mix_range": F.floor(place), "mix_part": F.floor((place - F.floor(place)) * PARTS)})
    slim = written(keyed.select(F.col(source_column).alias("source"), F.col(id_column).alias("id"), "mix_size", "mix_key", "mix_range", "mix_part"), "mixing")

    first = slim.groupBy("source", "mix_range").agg(F.sum("mix_size").alias("words"))
    sizes = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mixing")
    near = F.broadcast if targets.count() <= MOST_BROADCAST else (lambda x: x)

    # The range, then the part of it, in which each source's rest ends, and the words before it.
    range_end = near(_ending(_with(first, targets, "source").withColumn("base", F.lit(0).cast("long")), "mix_range"))
    second = slim.groupBy("source", "mix_range", "mix_part").agg(F.sum("mix_size").alias("words"))
    part_end = written(_ending(_with(second, range_end, "source", "mix_range"), "mix_part", "mix_range"), "mixing")
    # In that part, the first row of which less than half fits; it and all after it are left.
    order = Window.partitionBy("source").orderBy("mix_key", "id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    last = _with(slim, near(part_end), "source", "mix_range", "mix_part").withColumn("before", F.coalesce(F.sum("mix_size").over(order), F.lit(0)) + F.col("base"))
    last = last.where(F.col("before") + F.col("mix_size") / 2 > F.col("rest")).groupBy("source").agg(F.min(F.struct("mix_key", "id", "mix_size")).alias("stop"))
    limits = _with(_with(targets.drop("rest"), part_end.select("source", F.struct("mix_range", "mix_part").alias("end")), "source", how="left"), last, "source", how="left")

    rows = keyed.join(near(limits.withColumnRenamed("source", "mix_source")), keyed[source_column].eqNullSafe(F.col("mix_source")))
    here, key = F.struct("mix_range", "mix_part"), F.struct("mix_key", F.col(id_column).alias("id"), "mix_size")
    once = F.coalesce((here < F.col("end")) | (here == F.col("end")) & (F.col("stop").isNull() | (key < F.col("stop"))), F.lit(False))
    return rows.select(*[keyed[c] for c in columns], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), (F.col("epochs") + once.cast("long")).alias("mix_times"))


def _with(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """A join on columns of which null equals null; they come once."""
    right = right.withColumnsRenamed({c: f"right_{c}" for c in on})
    same = [left[c].eqNullSafe(right[f"right_{c}"]) for c in on]
    return left.join(right, same, how).drop(*[f"right_{c}" for c in on])


def _ending(sums: DataFrame, by: str, *kept: str) -> DataFrame:
    """Of each source, the range in which its rest ends, with the words before it (base)."""
    before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    sums = sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
    return sums.select("source", *kept, by, F.col("start").alias("base"), "rest")
