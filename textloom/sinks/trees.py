"""Any annotations as text: XML in the running text, XML with an element a line, vertical text, tables (csv) and CoNLL-U.

tables: span tables by name, from outer to inner: doc_id, idx, start, end, and the columns that become attributes; of equal spans the one of the
first table is outside (spans.writing_order() puts them so that all documents agree). Spans may cross: where one ends, those that were opened in it
are closed and opened again, and all parts of such a span have one number in the attribute overlap. Spans of no width come before others at their place.

A document's spans are put together by one grouping, and its text is cut once, front to back, in one pass over documents; segmented_tree() makes the spans of the texts itself and needs no exchange. A null text is
empty; a document without spans has its text (preserved) or nothing between the edges of its element. Null attributes are empty, and left out of XML.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import segmentation
from textloom.sinks.exporters import CONLLU, as_text, xml_escaped

Event = tuple[int, str, int]


def nested_events(spans: list[tuple[int, int]]) -> tuple[list[Event], dict[int, int]]:
    """(place, "open", "again" or "close", number of the span) in writing order of sorted spans, and numbers from 1 for those that cross others."""
    out: list[Event] = []
    open_: list[int] = []
    crossing: dict[int, int] = {}

    def close(until: float) -> None:
        while open_ and (end := min(spans[k][1] for k in open_)) <= until:
            first = next(i for i, k in enumerate(open_) if spans[k][1] == end)
            above = open_[first:]
            del open_[first:]
            out.extend((end, "close", k) for k in reversed(above))
            for k in above:
                if spans[k][1] > end:
                    crossing.setdefault(k, len(crossing) + 1)
                    out.append((end, "again", k))
                    open_.append(k)

    for k, (start, end) in enumerate(spans):
        close(start)
        out.append((start, "open", k))
        if start == end:
            out.append((start, "close", k))
        else:
            open_.append(k)
    close(float("inf"))
    return out, crossing


def scrambled_events(events: list[Event], chunks: list[tuple[int, int]], spans: list[tuple[int, int]]) -> Iterator[list[Event]]:
    """Of each chunk (span number, place in the new order) in the new order the events in it, spans around it being closed and opened again where it needs others than the one before."""
    now: list[int] = []
    around: dict[int, list[int]] = {}
    inside: dict[int, list[Event]] = {}
    wanted = {k for k, _ in chunks}
    stack: list[int] = []
    at = None
    for event in events:
        _, kind, k = event
        if at is None and kind != "close" and k in wanted:
            at, around[k], inside[k] = k, list(stack), []
        if at is not None:
            inside[at].append(event)
        if kind == "close":
            stack.remove(k)
            at = None if at == k and spans[k][1] <= event[0] else at
        else:
            stack.append(k)
    for k, _ in sorted(chunks, key=lambda c: c[1]):
        if k in inside:
            shared = next((i for i, (a, b) in enumerate(zip(now, around[k], strict=False)) if a != b), min(len(now), len(around[k])))
            place = spans[k][0]
            yield [(place, "close", x) for x in reversed(now[shared:])] + [(place, "open", x) for x in around[k][shared:]]
            now = around[k]
            yield inside[k]
    yield [(0, "close", x) for x in reversed(now)]


#: Styles in which elements are comment lines before their tokens.
COMMENTED = ("csv", "conllu")


def written(text: str, spans: list[tuple[int, int]], names: list[str], attributes: list[str], lines: list[str | None], style: str, chunks: list[tuple[int, int]] | None, breaks: str = "") -> str:
    """One document. lines: what stands for a span of the innermost table in all styles but preserved; None for others. breaks: in tables and CoNLL-U, after whose elements a line is left blank."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    events, crossing = nested_events(spans)
    out: list[str] = []
    depth = 0
    for part in scrambled_events(events, chunks, spans) if chunks is not None else [events]:
        at = part[0][0] if chunks is not None and part else 0
        for place, kind, k in part:
            if style == "preserved":
                out.append(escape(text[at:place]))
                at = max(at, place)
            if style in COMMENTED:
                out += [lines[k] + "\n" if lines[k] is not None else attributes[k]] if kind == "open" else ["\n"] if kind == "close" and names[k] == breaks else []
                continue
            shown = f"<{names[k]}{attributes[k]}" + (f' overlap="{crossing[k]}"' if k in crossing else "") + ">" if kind != "close" else f"</{names[k]}>"
            if style == "preserved":
                out.append(shown)
            elif lines[k] is None:
                depth -= kind == "close"
                out.append(("  " * (depth + 1) if style == "pretty" else "") + shown + "\n")
                depth += kind != "close"
            elif kind != "close":  # a token of which a part stands elsewhere is written once
                if kind == "open":
                    out.append(("  " * (depth + 1) + shown + lines[k] + f"</{names[k]}>" if style == "pretty" else lines[k]) + "\n")
        if style == "preserved" and chunks is None:
            out.append(escape(text[at:]))
    return "".join(out)


def tree(docs: DataFrame, tables: dict[str, DataFrame], attributes: dict[str, list[str]], style: str = "pretty", columns: tuple[str | None, ...] = ("word",), scramble: str | None = None, root: str = "text", breaks: str = "sentence", delimiter: str = "\t") -> DataFrame:
    """(doc_id, content): a row a document.

    attributes: by table the columns that are written. style: preserved, pretty, vertical, csv or conllu. The last table has the tokens, with ``columns``: vertical text has them
    between tabs, pretty XML has the first as the element's text, csv between delimiters (a blank in place of one in the first), CoNLL-U as its ten fields (columns of these names; None: none). In the latter two each element is a
    comment line for each attribute, or one with its name, and a blank line follows each element of the table ``breaks``. scramble: the table whose spans are reordered, by its column ``place``; what stands in none of them goes.
    """
    def attribute(c: str) -> Column:
        return F.when(as_text(c) != "", F.concat(F.lit(f' {c}="'), xml_escaped(as_text(c)), F.lit('"'))).otherwise("")

    def comments(name: str) -> Column:
        own = attributes.get(name, [])
        shown = "sent" if name == "sentence" and style == "conllu" else name
        told = [F.concat(F.lit(f"# {shown}{'_' if style == 'conllu' else '.'}{c} = "), as_text(c), F.lit("\n")) for c in own]
        told = told if style == "conllu" else [F.when(as_text(c) != "", t).otherwise("") for c, t in zip(own, told, strict=True)]
        every = F.concat(F.lit(""), *told)
        return F.when(every == "", f"# {name}\n").otherwise(every)

    def token_line() -> Column:
        if style == "csv":
            return F.concat_ws(delimiter, F.replace(as_text(columns[0]), F.lit(delimiter), F.lit(" ")), *[as_text(c) for c in columns[1:]])
        bare = [F.when(F.trim(as_text(c), F.lit("|")) == "", "_").otherwise(F.trim(as_text(c), F.lit("|"))) if c else F.lit("_") for c in columns]
        bare[2], bare[6], bare[7] = F.substring_index(bare[2], "|", 1), F.when(bare[6] == "_", "0").otherwise(bare[6]), F.lower(bare[7])
        return F.concat_ws("\t", *bare)

    cell = lambda c: xml_escaped(F.regexp_replace(as_text(c), r"[\t\n]", " "))
    every = None
    for level, (name, table) in enumerate(tables.items()):
        token = level == len(tables) - 1 and style != "preserved"
        shown = {"vertical": lambda: F.concat_ws("\t", *[cell(c) for c in columns]), "csv": token_line, "conllu": token_line}.get(style, lambda: xml_escaped(as_text(columns[0])))
        line = shown() if token else F.lit(None).cast("string")
        wide = F.col("end").cast("long") > F.col("start").cast("long")
        span = F.struct(
            F.col("start").cast("int").alias("start"), wide.alias("wide"), (-F.col("end")).cast("int").alias("far"), F.lit(level).alias("level"), F.col("idx").cast("long").alias("idx"), F.col("end").cast("int").alias("end"), F.lit(name).alias("name"),
            (comments(name) if style in COMMENTED else F.concat(F.lit(""), *[attribute(c) for c in attributes.get(name, [])])).alias("attributes"), line.alias("line"), (F.col("place").cast("long") if name == scramble else F.lit(None).cast("long")).alias("place"),
        )
        part = table.select(F.col("doc_id").alias("s_doc"), span.alias("span"))
        every = part if every is None else every.unionByName(part)
    spans = every.groupBy("s_doc").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans, F.col("doc_id") == F.col("s_doc"), "left")

    @F.pandas_udf("string")
    def content(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, own: list[dict] | None) -> str:
            own = [] if own is None else own
            chunks = [(i, s["place"]) for i, s in enumerate(own) if s["place"] is not None] if scramble else None
            return written(t, [(s["start"], s["end"]) for s in own], [s["name"] for s in own], [s["attributes"] for s in own], [s["line"] for s in own], style, chunks, breaks)

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)])

    if style in COMMENTED:
        head = delimiter.join(columns) if style == "csv" else "# global.columns = " + " ".join(CONLLU)
        return own.select("doc_id", F.concat(F.lit(head + "\n"), content("text", "spans"), F.lit("\n" * (style == "conllu"))).alias("content"))
    edge = "\n" if style != "preserved" else ""
    return own.select("doc_id", F.concat(F.lit(f'<{root} id="'), xml_escaped(F.col("doc_id").cast("string")), F.lit(f'">{edge}'), content("text", "spans"), F.lit(f"</{root}>\n")).alias("content"))


Columns = Callable[[dict[str, pa.Array]], dict[str, pa.Array]]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _shown(values: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(values, pa.string()), "")


def _escaped(values: pa.Array) -> pa.Array:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        values = pc.replace_substring(values, plain, entity)
    return values


def segmented_tree(
    docs: DataFrame, outer: tuple[str, str | Callable], inner: tuple[str, str | Callable], attributes: dict[str, list[str]], style: str = "pretty", columns: tuple[str | None, ...] = ("word",), scramble: str | None = None, root: str = "text", breaks: str = "sentence",
    delimiter: str = "\t", derived: dict[str, Columns] | None = None,
) -> DataFrame:
    """(doc_id, content): as tree(), for two tables that segmenters make of the texts, in one pass over docs and without an exchange.

    outer, inner: a table's name and its segmenter. Tables have idx, start and end, the inner one also word, and, where an outer span holds the token, parent (its idx) and ref (the token's place in it, from 1), else
    null. derived: by table what makes more columns of these, all spans of some documents at a time, such as ``place`` where the outer table is scrambled. Each row of docs gives one of its own.
    """
    (upper, cut_upper), (lower, cut_lower) = outer, inner
    make = derived or {}
    cutters = segmentation._cutter(cut_upper), segmentation._cutter(cut_lower)
    head = {"csv": lambda: delimiter.join(columns) + "\n", "conllu": lambda: "# global.columns = " + " ".join(CONLLU) + "\n"}.get(style, lambda: "")()
    tail = "\n" if style == "conllu" else ""
    edge = "\n" if style != "preserved" else ""

    def attribute_text(name: str, own: dict[str, pa.Array], n: int) -> pa.Array:
        """What stands in a span's opening mark, or its comment lines."""
        empty, kept = pa.repeat(pa.scalar(""), n), attributes.get(name, [])
        if style not in COMMENTED:
            values_ = [(c, _shown(own[c])) for c in kept]
            return _joined(empty, *[pc.if_else(pc.equal(v, ""), "", _joined(f' {c}="', _escaped(v), '"')) for c, v in values_])
        shown = "sent" if name == "sentence" and style == "conllu" else name
        told = [(v, _joined(f"# {shown}{'_' if style == 'conllu' else '.'}{c} = ", v, "\n")) for c, v in ((c, _shown(own[c])) for c in kept)]
        every = _joined(empty, *[t if style == "conllu" else pc.if_else(pc.equal(v, ""), "", t) for v, t in told])
        return pc.if_else(pc.equal(every, ""), f"# {name}\n", every)

    def token_lines(own: dict[str, pa.Array]) -> pa.Array:
        if style in ("pretty", "preserved"):
            return _escaped(_shown(own[columns[0]] if style == "pretty" else own["word"]))
        if style == "vertical":
            return pc.binary_join_element_wise(*[_escaped(pc.replace_substring_regex(_shown(own[c]), r"[\t\n]", " ")) for c in columns], "\t")
        if style == "csv":
            return pc.binary_join_element_wise(pc.replace_substring(_shown(own[columns[0]]), delimiter, " "), *[_shown(own[c]) for c in columns[1:]], delimiter)
        blank = pa.repeat(pa.scalar("_"), len(own["idx"]))
        bare = [pc.if_else(pc.equal(v, ""), "_", v) if v is not None else blank for v in (pc.utf8_trim(_shown(own[c]), "|") if c else None for c in columns)]
        bare[2], bare[6], bare[7] = pc.replace_substring_regex(bare[2], r"(?s)\|.*", ""), pc.if_else(pc.equal(bare[6], "_"), "0", bare[6]), pc.utf8_lower(bare[7])
        return pc.binary_join_element_wise(*bare, "\t")

    def content(batch: pa.RecordBatch) -> pa.Array:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        tables = []
        for cut in cutters:
            lists = [cut(t) for t in texts]
            _, idx, start, end = segmentation._span_columns(pa.array(range(len(texts))), lists)
            tables.append((lists, np.array([len(x) for x in lists], np.int64), {"idx": idx, "start": start, "end": end}))
        (lists_u, n_u, own_u), (lists_t, n_t, own_t) = tables
        place = lambda own, n, c: own[c].to_numpy().astype(np.int64) + np.repeat(base[:-1], n)
        us, ue, ts, te = place(own_u, n_u, "start"), place(own_u, n_u, "end"), place(own_t, n_t, "start"), place(own_t, n_t, "end")
        parent = np.searchsorted(us, ts, "right") - 1
        many = len(us) > 0
        inside = (parent >= 0) & (te <= ue[parent]) if many else np.zeros(len(ts), bool)
        after = np.append(us, np.iinfo(np.int64).max)[parent + 1]
        crossing = ~inside & (((parent >= 0) & (ts < ue[parent]) if many else False) | (te > after))
        first = np.searchsorted(np.where(inside, parent, -1)[inside], np.arange(len(us)), "left")
        ref = np.cumsum(inside) - 1 - (first[parent] if many else 0) + 1
        own_t |= {"word": pa.array([t[a:b] for t, spans in zip(texts, lists_t, strict=True) for a, b in spans], pa.string()), "ref": pa.array(ref, pa.int64(), mask=~inside)}
        own_t["parent"] = own_u["idx"].take(pa.array(parent, pa.int64(), mask=~inside)) if many else pa.nulls(len(ts), pa.int32())
        own_u |= make.get(upper, lambda own: {})(own_u)
        own_t |= make.get(lower, lambda own: {})(own_t)
        marks_u, marks_t, lines = attribute_text(upper, own_u, len(us)), attribute_text(lower, own_t, len(ts)), token_lines(own_t)

        if style in COMMENTED:
            opened, closed, shown = marks_u, pa.repeat(pa.scalar("\n" if upper == breaks else ""), len(us)), _joined(lines, "\n" + "\n" * (lower == breaks))
        else:
            end = "" if style == "preserved" else "\n"
            deep, deeper = ("  ", pc.if_else(pa.array(inside), "    ", "  ")) if style == "pretty" else ("", "")
            opened, closed = _joined(f"{deep}<{upper}", marks_u, f">{end}"), pa.repeat(pa.scalar(f"{deep}</{upper}>{end}"), len(us))
            shown = _joined(lines, "\n") if style == "vertical" else _joined(deeper, f"<{lower}", marks_t, ">", lines, f"</{lower}>{end}")
        # The places of all pieces in writing order.
        j = np.arange(len(us))
        at_open, at_close = np.searchsorted(ts, us, "left") + 2 * j, np.searchsorted(ts, ue, "left") + 2 * j + 1
        at_token = np.arange(len(ts)) + np.searchsorted(us, ts, "right") + np.searchsorted(ue, ts, "right")
        order = np.empty(len(ts) + 2 * len(us), np.int64)
        irregular = np.zeros(len(texts), bool)
        irregular[np.repeat(np.arange(len(texts)), n_t)[crossing]] = True
        sizes = n_t + 2 * n_u
        if irregular.any():  # their pieces are not used, but need places that no other has
            of = np.concatenate([np.repeat(np.arange(len(texts)), n_t), np.repeat(np.arange(len(texts)), n_u), np.repeat(np.arange(len(texts)), n_u)])
            keys = np.concatenate([at_token, at_open, at_close])
            order = np.lexsort((keys, of))
        else:
            order[at_token], order[at_open], order[at_close] = np.arange(len(ts)), len(ts) + j, len(ts) + len(us) + j
        pieces = pa.concat_arrays([pa.array(x) if not isinstance(x, pa.Array) else x for x in (shown, opened, closed)])
        if style == "preserved":  # what stands between marks
            mark_start, mark_end = np.concatenate([ts, us, ue])[order], np.concatenate([te, us, ue])[order]
            before = np.empty_like(mark_start)
            before[1:] = mark_end[:-1]
            firsts = np.cumsum(sizes) - sizes
            before[firsts[sizes > 0]] = base[:-1][sizes > 0]
            if scramble:
                before = np.where(order[:] >= len(ts), np.where(order < len(ts) + len(us), mark_start, before), before)
            owner = np.repeat(np.arange(len(texts)), sizes)
            a, b = (before - base[owner]).tolist(), (mark_start - base[owner]).tolist()
            gaps = pa.array([texts[k][x:y] if x < y else "" for k, x, y in zip(owner.tolist(), a, b, strict=True)], pa.string())
            pieces = _joined(_escaped(gaps), pieces.take(pa.array(order)))
        else:
            pieces = pieces.take(pa.array(order))
        ends = np.cumsum(sizes)
        if scramble:  # whole chunks in another order; what stands in none goes
            if irregular.any():
                at_open = at_close = np.zeros(0, np.int64)
                chosen, sizes_s = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
            owner = np.repeat(np.arange(len(texts)), n_u)
            if not irregular.any():
                sorted_ = np.lexsort((j, own_u["place"].to_numpy(zero_copy_only=False), owner))
                sorted_ = sorted_[np.asarray(own_u["place"].is_valid())[sorted_]]
                length = (at_close - at_open + 1)[sorted_]
                starts = np.cumsum(length) - length
                chosen = np.arange(int(length.sum())) - np.repeat(starts, length) + np.repeat(at_open[sorted_], length)
                sizes_s = np.bincount(owner[sorted_], weights=length, minlength=len(texts)).astype(np.int64)
            pieces, ends = pieces.take(pa.array(chosen)), np.cumsum(sizes_s)
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pieces), "")
        if style == "preserved" and not scramble:
            last = np.array([te_[-1] if len(te_) else 0 for te_ in ([max([*(b for _, b in u[-1:]), *(b for _, b in t[-1:])])] if u or t else [] for u, t in zip(lists_u, lists_t, strict=True))])
            out = _joined(out, _escaped(pa.array([t[k:] for t, k in zip(texts, last.tolist(), strict=True)], pa.string())))
        if irregular.any():
            whole, starts_u, starts_t = out.to_pylist(), np.cumsum(n_u) - n_u, np.cumsum(n_t) - n_t
            for k in range(len(texts)) if scramble else np.flatnonzero(irregular).tolist():
                rows = [((a, -b, 0, i), starts_u[k] + i, upper) for i, (a, b) in enumerate(lists_u[k])] + [((a, -b, 1, i), starts_t[k] + i, lower) for i, (a, b) in enumerate(lists_t[k])]
                rows.sort(key=lambda r: r[0])
                spans, names = [(r[0][0], -r[0][1]) for r in rows], [r[2] for r in rows]
                told = [(marks_u if r[2] == upper else marks_t)[int(r[1])].as_py() for r in rows]
                each = [lines[int(r[1])].as_py() if r[2] == lower and style != "preserved" else None for r in rows]
                chunks = [(i, own_u["place"][int(r[1])].as_py()) for i, r in enumerate(rows) if r[2] == upper and own_u["place"][int(r[1])].is_valid] if scramble else None
                whole[k] = written(texts[k], spans, names, told, each, style, chunks, breaks)
            out = pa.array(whole, pa.string())
        return _joined(head, out, tail) if style in COMMENTED else _joined(f'<{root} id="', _escaped(batch.column("shown")), f'">{edge}', out, f"</{root}>\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in segmentation._parts(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), content(part)], ["doc_id", "content"])

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("shown"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, content string")
