"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written

MOST_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) from (a, b): the smallest node that each node of an edge reaches, itself included.

    Every round joins each edge with its node's smallest neighbour; edges become stars in few
    rounds. Nulls and loops are left out; an edge table without rows gives none.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where((a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = written(small.where(a != b).distinct(), "edges")
    else:
        raise RuntimeError(f"edges are no stars after {MOST_ROUNDS} rounds")
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root"))).distinct()


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of connected() with further edges: only components that these join are worked on."""
    named = edges.select("a", "b")
    for end in ("a", "b"):
        named = named.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    new = written(connected(named), "roots")
    known = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("new_root")), "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    return known.unionByName(new.join(roots.select("node"), "node", "left_anti").select("node", "root"))
