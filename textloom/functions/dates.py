"""Dates in text: formats are tried in turn, and the end of a date's unit is its to-date.

Formats are written as for strptime (%Y-%m-%d) and translated to Spark's patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's pattern letters by strptime directive.
PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "a": "E", "A": "EEEE", "j": "DDD"}
# The regular expression of what each directive takes.
TAKES = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "b": r"\p{L}{3}\.?", "B": r"\p{L}+", "H": r"\d{1,2}", "I": r"\d{1,2}", "p": "[AaPp][Mm]", "M": r"\d{1,2}", "S": r"\d{1,2}", "a": r"\p{L}{3}", "A": r"\p{L}+", "j": r"\d{1,3}", "3Y": r"\d{3}", "0m": r"\d{2}", "0d": r"\d{2}"}
DIRECTIVE = re.compile(r"%(3Y|0m|0d|[A-Za-z])")
#: The units of a date from coarse to fine, with the directives that give them.
UNITS = (("year", ("Y", "3Y", "y")), ("month", ("b", "B", "m", "0m")), ("day", ("d", "0d", "j")), ("hour", ("H", "I")), ("minute", ("M",)), ("second", ("S",)))


def _pieces(fmt: str) -> list[tuple[str | None, str]]:
    """(directive, literal) in turn."""
    out, at = [], 0
    for m in DIRECTIVE.finditer(fmt):
        out += [(None, fmt[at : m.start()])] * (m.start() > at) + [(m[1], "")]
        at = m.end()
    return out + [(None, fmt[at:])] * (at < len(fmt))


def smallest_unit(fmt: str) -> str | None:
    """The finest unit of a format without a gap from the year on; None without a year."""
    given, finest = {d for d, _ in _pieces(fmt) if d}, None
    for unit, directives in UNITS:
        if not given & set(directives):
            return finest
        finest = unit
    return finest


def parsed(value: Column, fmt: str) -> Column:
    """The timestamp of a value, null where the value is not of the format. %3Y takes three digits, %0m and %0d exactly two."""
    regex, pattern = "", ""
    for directive, literal in _pieces(fmt):
        regex += TAKES[directive] if directive else re.escape(literal)
        pattern += {"3Y": "yyyy", "0m": "MM", "0d": "dd"}.get(directive, PATTERNS.get(directive, "")) if directive else "'" + literal.replace("'", "''") + "'"
    # One-digit parts are filled up, since Spark's two-letter patterns want two digits.
    groups = [d for d, _ in _pieces(fmt)]
    capture = "".join(f"({TAKES[d]})" if d else f"({re.escape(x)})" for d, x in _pieces(fmt))
    filled = F.concat(*[F.lpad(F.regexp_extract(value, f"^{capture}$", i + 1), {"3Y": 4, "j": 3}.get(d, 2), "0") if d in ("m", "d", "H", "I", "M", "S", "3Y", "j") else F.regexp_extract(value, f"^{capture}$", i + 1) for i, d in enumerate(groups)])
    return F.when(value.rlike(f"^{regex}$"), F.try_to_timestamp(filled, F.lit(pattern)))


def _first(value: Column, formats: list[str]) -> Column:
    """(start, end): the first format that fits gives the timestamp, and the last second of its finest unit."""
    tries = []
    for fmt in formats:
        at, unit = parsed(value, fmt), smallest_unit(fmt)
        end = at + F.expr(f"interval 1 {unit}") - F.expr("interval 1 second") if unit and unit != "second" else at
        tries.append(F.when(at.isNotNull(), F.struct(at.alias("start"), end.alias("end"), F.lit(fmt).alias("fmt"))))
    return F.coalesce(*tries)


def _shown(at: Column, fmt: str) -> Column:
    return F.date_format(at, "".join(PATTERNS.get(d, "") if d else "'" + x.replace("'", "''") + "'" for d, x in _pieces(fmt)))


def _prepared(value: Column, regex: str | None) -> Column:
    """The first group of ``regex`` that matched at the value's start, or the value."""
    if not regex:
        return value
    n = re.compile(regex).groups
    return F.coalesce(*[F.nullif(F.regexp_extract(value, f"^(?:{regex})", i + 1), F.lit("")) for i in range(n)], F.lit(""))


def date_range(first: Column, last: Column | None, informat: str, outformat: str, splitter: str | None = None, pre_regex: str | None = None, strict: bool = False) -> Column:
    """A struct of texts (date_from, date_to), '' where there is no date.

    informat: formats between |, tried in turn. outformat: one for all of them, or one for each. splitter: separates a from- and a to-date in one
    value. strict: a value that no format fits is an error instead of ''.
    """
    formats, out = informat.strip("|").split("|"), outformat.split("|")
    if len(out) not in (1, len(formats)):
        raise ValueError("outformat must be one format, or as many as informat has")
    last = first if last is None else last
    ends = []
    for value, place in ((F.trim(first), 0), (last, -1)):
        value = _prepared(F.coalesce(value, F.lit("")), pre_regex)
        if splitter:
            parts = F.split(value, re.escape(splitter))
            value = F.trim(F.element_at(parts, 1 if place == 0 else -1))
        found = _first(value, formats)
        at = found["start"] if place == 0 else found["end"]
        shown = _shown(at, out[0])
        for fmt, o in zip(formats[1:], out[1:], strict=False):
            shown = F.when(found["fmt"] == fmt, _shown(at, o)).otherwise(shown)
        if strict:
            shown = F.when((value != "") & found.isNull(), F.raise_error(F.concat(F.lit("no date format fits "), value))).otherwise(shown)
        ends.append(F.coalesce(shown, F.lit("")))
    return F.struct(ends[0].alias("date_from"), ends[1].alias("date_to"))


def resolutions(informat: str) -> str:
    """Which units the formats hold, as Y, M, D, h, m, s; finest format first, between |."""
    marks = {"year": "Y", "month": "M", "day": "D", "hour": "h", "minute": "m", "second": "s"}
    out = []
    for fmt in informat.strip("|").split("|") if informat else []:
        given = {d for d, _ in _pieces(fmt) if d}
        out.append("".join(marks[u] for u, d in UNITS if given & ({*d} | ({"a", "A", "w"} if u == "day" else set()))))
    return "|".join(sorted(out, key=len, reverse=True))
