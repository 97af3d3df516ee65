"""Relations between span tables: containment, span texts, white space, merging.

Span tables have doc_id, idx, start and end; they may have start_sub and end_sub, which order what begins or ends at one code point. Sub-positions of two spans are compared only
where both have them. Containment joins are equi-joins on the document and a bin of its code points with the
range as a further condition, so that one long document is spread over many keys and no pair of far-off spans is compared.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points in a bin.
BIN = 2048


SUB = ("start_sub", "end_sub")


def _not_after(a: str, a_sub: str, b: str, b_sub: str, subs: bool) -> Column:
    """a is not after b; at one code point sub-positions decide if both are there."""
    if not subs:
        return F.col(a) <= F.col(b)
    same = F.col(a_sub).isNull() | F.col(b_sub).isNull() | (F.col(a_sub) <= F.col(b_sub))
    return (F.col(a) < F.col(b)) | (F.col(a) == F.col(b)) & same


def parents(child: DataFrame, parent: DataFrame, keep_orphans: bool = True, disjoint: bool = False) -> DataFrame:
    """The child's columns and parent_idx, the first parent by (start, start_sub, end, end_sub, idx) that contains the child; null for orphans.

    Exact for children that do not overlap, such as tokens and sentences; see parents_in_order for others. disjoint: parents do not overlap, so parents_disjoint() does it.
    """
    if disjoint:
        return parents_disjoint(child, parent, keep_orphans)
    subs = {*SUB} <= {*child.columns} and {*SUB} <= {*parent.columns}
    outer = parent.select(F.col("doc_id").alias("p_doc"), *[F.col(c).alias(f"p_{c}") for c in ("start", "end", "idx", *(SUB if subs else ()))])
    outer = outer.withColumn("p_bin", F.explode(F.sequence(F.floor(F.col("p_start") / BIN), F.floor(F.col("p_end") / BIN))))
    inner = child.withColumn("c_bin", F.floor(F.col("start") / BIN))
    inside = _not_after("p_start", "p_start_sub", "start", "start_sub", subs) & _not_after("end", "end_sub", "p_end", "p_end_sub", subs)
    hits = inner.join(outer, (F.col("doc_id") == F.col("p_doc")) & (F.col("c_bin") == F.col("p_bin")) & inside, "left" if keep_orphans else "inner")
    order = ["p_start", "p_start_sub", "p_end", "p_end_sub", "p_idx"] if subs else ["p_start", "p_end", "p_idx"]
    first = F.min(F.when(F.col("p_idx").isNotNull(), F.struct(*order)))["p_idx"].alias("parent_idx")
    others = [c for c in child.columns if c not in ("doc_id", "idx")]
    return hits.groupBy("doc_id", "idx").agg(*[F.first(c).alias(c) for c in others], first).select(*child.columns, "parent_idx")


def parents_disjoint(child: DataFrame, parent: DataFrame, keep_orphans: bool = True) -> DataFrame:
    """As parents(), for parents that do not overlap: one sort of both tables by place, no join. Of parents that touch at one place the later one is that of what stands there."""
    subs = {*SUB} <= {*child.columns} and {*SUB} <= {*parent.columns}
    place = ["start", "start_sub"] if subs else ["start"]
    outer = parent.select("doc_id", *place, F.struct("start", "end", "idx", *(SUB if subs else ())).alias("p"))
    both = child.withColumns({"p": F.lit(None).cast(outer.schema["p"].dataType), "is_child": F.lit(1)}).unionByName(outer.withColumn("is_child", F.lit(0)), allowMissingColumns=True)
    last = F.last("p", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(*place, "is_child").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("p", last).where("is_child = 1")
    inside = _not_after("end", "end_sub", "p.end", "p.end_sub", subs)
    out = found.select(*child.columns, F.when(inside, F.col("p.idx")).alias("parent_idx"))
    return out if keep_orphans else out.where("parent_idx is not null")


def parents_in_order(child: DataFrame, parent: DataFrame) -> DataFrame:
    """As parents(), but a parent that ends before some child is given up for all children after it, as one sweep over both would.

    The sweep is made per document: documents must fit in a task.
    """
    schema = child.withColumn("parent_idx", F.lit(None).cast(dict(parent.dtypes)["idx"])).schema

    def sweep(key: tuple, inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        outer = outer.sort_values(["start", "end", "idx"])
        inner = inner.sort_values(["start", "end", "idx"])
        rows, at, found = outer[["start", "end", "idx"]].to_numpy().tolist(), 0, []
        for start, end in inner[["start", "end"]].to_numpy().tolist():
            while at < len(rows) and end > rows[at][1]:
                at += 1
            found.append(rows[at][2] if at < len(rows) and rows[at][0] <= start else None)
        return inner.assign(parent_idx=pd.array(found, "Int64"))

    return child.groupBy("doc_id").cogroup(parent.groupBy("doc_id")).applyInPandas(sweep, schema)


def children(parent: DataFrame, child: DataFrame, disjoint: bool = False) -> DataFrame:
    """The parent's columns and children, the array of its children's idx in order; empty for a parent without any. disjoint: as in parents()."""
    inside = parents(child, parent, False, disjoint).groupBy(F.col("doc_id").alias("c_doc"), "parent_idx").agg(F.array_sort(F.collect_list("idx")).alias("children"))
    out = parent.join(inside, (F.col("doc_id") == F.col("c_doc")) & (F.col("idx") == F.col("parent_idx")), "left")
    return out.select(*parent.columns, F.coalesce("children", F.array().cast("array<int>")).alias("children"))


def orphans(child: DataFrame, parent: DataFrame, disjoint: bool = False) -> DataFrame:
    """Children that no parent contains."""
    return parents(child, parent, disjoint=disjoint).where("parent_idx is null").drop("parent_idx")


def inherit(child: DataFrame, parent: DataFrame, attribute: str, name: str | None = None, disjoint: bool = False) -> DataFrame:
    """The child's columns and its parent's attribute, '' for orphans."""
    value = parent.select(F.col("doc_id").alias("p_doc"), F.col("idx").alias("p_idx"), F.col(attribute).alias("p_value"))
    out = parents(child, parent, disjoint=disjoint)
    out = out.join(value, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_idx") == F.col("p_idx")), "left")
    return out.select(*child.columns, F.coalesce("p_value", F.lit("")).alias(name or f"inherit_{attribute}"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut_texts(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The pieces of each text; expressions would count its characters anew for each piece."""
    return pd.Series([None if t is None or a is None else [t[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] for t, a, b in zip(text, starts, ends, strict=True)], dtype=object)


def span_texts(spans: DataFrame, docs: DataFrame, keep_format_characters: bool = False) -> DataFrame:
    """The span's columns and word, its text without format characters (with them if nothing else is in it). Spans meet their text once a document."""
    lists = spans.groupBy(F.col("doc_id").alias("t_doc")).agg(F.collect_list(F.struct(*spans.columns)).alias("spans"))
    own = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("t_doc")).select("spans", cut_texts("text", "spans.start", "spans.end").alias("words"))
    out = own.select(F.explode(F.arrays_zip("spans", "words")).alias("z")).select("z.spans.*", F.col("z.words").alias("word"))
    if not keep_format_characters:
        plain = F.regexp_replace("word", r"\p{Cf}", "")
        out = out.withColumn("word", F.when(plain == "", F.col("word")).otherwise(plain))
    return out.select(*spans.columns, "word")


def head_tail(tokens: DataFrame, docs: DataFrame, longest: int | None = None) -> DataFrame:
    """The tokens' columns with head and tail: white space before and after them, as \\s, \\n and \\t.

    What follows a token up to the last line break of the gap is its tail; the rest is the next token's head.
    """
    order = F.struct("start", "end", "idx", F.struct(*tokens.columns).alias("token"))
    lists = tokens.groupBy(F.col("doc_id").alias("t_doc")).agg(F.array_sort(F.collect_list(order)).alias("spans"))
    own = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("t_doc")).select("text", "spans")
    following = F.transform("spans", lambda s, i: F.greatest(s["end"], F.coalesce(F.get("spans", i + 1)["start"], F.length("text"))))
    own = own.select("spans.token", cut_texts("text", "spans.end", following).alias("gaps"))
    # What stands after the gap's last line break goes to the next token.
    carried = F.transform("gaps", lambda g: F.when(F.contains(g, F.lit("\n")), F.substring_index(g, "\n", -1)).otherwise(""))
    own = own.select("token", "gaps", carried.alias("carried"))
    head = F.transform("gaps", lambda g, i: F.when(i > 0, F.get("carried", i - 1)).otherwise(""))
    tail = F.transform("gaps", lambda g, i: g.substr(F.lit(1), F.length(g) - F.length(F.get("carried", i))))
    own = own.select(F.explode(F.arrays_zip("token", head.alias("head"), tail.alias("tail"))).alias("z")).select("z.token.*", "z.head", "z.tail")
    for name in ("head", "tail"):
        kept = F.col(name) if longest is None else F.substring(name, 1, longest)
        for plain, written in ((" ", "\\s"), ("\n", "\\n"), ("\t", "\\t")):
            kept = F.replace(kept, F.lit(plain), F.lit(written))
        own = own.withColumn(name, kept)
    return own.select(*tokens.columns, "head", "tail")


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, annotation, idx, start, end): several span tables as one stream; order it by doc_id, start, end. With start_sub and end_sub if one of them has these."""
    subs = [c for c in SUB if any(c in t.columns for t in tables.values())]
    sub = lambda t, c: (F.col(c) if c in t.columns else F.lit(None)).cast("int").alias(c)
    parts = [t.select("doc_id", F.lit(name).alias("annotation"), "idx", "start", "end", *[sub(t, c) for c in subs]) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def element_order(tables: dict[str, DataFrame]) -> DataFrame:
    """(outer, inner, n): how many spans of an annotation lie in some span of another one of the same document; one containment join for all pairs."""
    every = merged(tables)
    outer = every.select(F.col("doc_id").alias("p_doc"), F.col("annotation").alias("outer"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    outer = outer.withColumn("p_bin", F.explode(F.sequence(F.floor(F.col("p_start") / BIN), F.floor(F.col("p_end") / BIN))))
    inner = every.withColumn("c_bin", F.floor(F.col("start") / BIN))
    inside = (F.col("doc_id") == F.col("p_doc")) & (F.col("c_bin") == F.col("p_bin")) & (F.col("p_start") <= F.col("start")) & (F.col("end") <= F.col("p_end")) & (F.col("annotation") != F.col("outer"))
    pairs = inner.join(outer, inside).select("doc_id", "annotation", "idx", "outer").distinct()
    counts = pairs.groupBy("outer", F.col("annotation").alias("inner")).agg(F.count("*").alias("n"))
    every_pair = every.sparkSession.createDataFrame([(a, b) for a in tables for b in tables if a != b], "outer string, inner string")
    return every_pair.join(counts, ["outer", "inner"], "left").select("outer", "inner", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def writing_order(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables from outer to inner, by a vote of all documents: of two annotations the one that more spans of the other lie in is outside.

    The order is total: annotations stand by the number of others they are outside of, and by name where that is equal, as it is for those that are outside of each other in a circle.
    """
    inside = {(r["outer"], r["inner"]): r["n"] for r in element_order(tables).collect()} if len(tables) > 1 else {}  # two rows for each pair of annotations
    wins = {a: sum(inside[a, b] > inside[b, a] for b in tables if b != a) for a in tables}
    return {name: tables[name] for name in sorted(tables, key=lambda name: (-wins[name], name))}


def events(tables: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, at, opens, annotation, idx, rank): opening and closing marks of nested spans in writing order.

    tables go from outer to inner (writing_order() tells how). At one place closings come before openings, inner closings first; openings go by sub-position, spans without one first, then wider
    spans open first; spans of no width open and close between the two.
    """
    level = F.create_map(*[F.lit(x) for i, name in enumerate(tables) for x in (name, i)])
    every = merged(tables)
    spans = every.withColumns({c: F.lit(None).cast("int") for c in SUB if c not in every.columns}).withColumn("level", level[F.col("annotation")]).withColumn("empty", F.col("start") == F.col("end"))
    sub = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    whole = lambda c: F.col(c).cast("long")
    open_ = F.struct(
        F.col("start").alias("at"), F.when(F.col("empty"), 1).otherwise(2).alias("phase"), sub("start_sub").alias("k1"), (-whole("end")).alias("k2"), (-sub("end_sub")).alias("k3"), F.col("level").alias("depth"), F.lit(True).alias("opens"))
    close = F.struct(
        F.col("end").alias("at"), F.when(F.col("empty"), 1).otherwise(0).alias("phase"), F.when(F.col("empty"), sub("start_sub")).otherwise(-whole("start")).alias("k1"), F.when(F.col("empty"), -whole("end")).otherwise(-sub("start_sub")).alias("k2"),
        F.when(F.col("empty"), -sub("end_sub")).otherwise(sub("end_sub")).alias("k3"), F.when(F.col("empty"), F.col("level")).otherwise(-F.col("level")).alias("depth"), F.lit(False).alias("opens"))
    out = spans.select("doc_id", "annotation", "idx", F.explode(F.array(open_, close)).alias("e")).select("doc_id", "annotation", "idx", "e.*")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "phase", "k1", "k2", "k3", "depth", "idx", F.desc("opens")))
    return out.select("doc_id", "at", "opens", "annotation", "idx", rank.alias("rank"))


def split_overlaps(spans: DataFrame) -> DataFrame:
    """(doc_id, annotation, idx, start, end, part, overlaps): spans cut where another one crosses them, so that all are nested.

    The one that begins later is cut at the end of the one it crosses. Each document is handled in one task.
    """
    schema = spans.select("doc_id", "annotation", "idx", "start", "end").withColumns({"part": F.lit(0), "overlaps": F.lit(False)}).schema

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start", "end", "annotation", "idx"], ascending=[True, False, True, True])
        rows: list = []
        open_: list[int] = []
        for doc, name, idx, start, end in frame[["doc_id", "annotation", "idx", "start", "end"]].itertuples(index=False):
            open_ = [e for e in open_ if e > start]
            edges = [start, *sorted({e for e in open_ if start < e < end}), end]
            rows += [(doc, name, idx, a, b, k, len(edges) > 2) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            open_ += edges[1:]
        return pd.DataFrame(rows, columns=schema.names)

    return spans.groupBy("doc_id").applyInPandas(lambda frame: cut(frame), schema)


def chain(first: DataFrame, *mappings: DataFrame, default: str | None = None) -> DataFrame:
    """(key, value): a key's value followed through mappings of key to value; the default where one has no entry."""
    out = first.select("key", "value")
    for m in mappings:
        nxt = m.select(F.col("key").alias("m_key"), F.col("value").alias("m_value"))
        out = out.join(nxt, F.col("value") == F.col("m_key"), "left").select("key", F.col("m_value").alias("value"))
    return out.select("key", F.coalesce("value", F.lit(default)).alias("value"))


def scrambled(chunks: DataFrame, seed_column: str = "idx") -> DataFrame:
    """chunks with place, their new order in the document: a fixed shuffle by a digest of document and number."""
    shuffle = F.xxhash64(F.col("doc_id"), F.col(seed_column))
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(shuffle, "idx")) - 1)

