"""Presentation of results: sizes, times, labels, previews and highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 100 * 1024
MAX_HIGHLIGHTS = 500


def format_size(size: Column) -> Column:
    """B, or KB, MB or GB with one decimal; ties round to even."""
    tenths = lambda unit: F.bround(size / float(unit), 1)
    return (
        F.when(size < 1 << 10, F.format_string("%d B", size))
        .when(size < 1 << 20, F.format_string("%.1f KB", tenths(1 << 10)))
        .when(size < 1 << 30, F.format_string("%.1f MB", tenths(1 << 20)))
        .otherwise(F.format_string("%.1f GB", tenths(1 << 30)))
    )


def format_time(seconds: Column) -> Column:
    """Minutes in the session's time zone; empty for null and 0."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"))


def match_label(kind: Column) -> Column:
    return F.when(kind == "filename", "file name").when(kind == "content", "content").when(kind == "both", "file name and content").otherwise(kind)


def filetime_to_unix(ticks: Column) -> Column:
    """Unix seconds of 100 ns ticks since 1601; 0 stays 0."""
    return F.when(ticks == 0, F.lit(0.0)).otherwise((ticks - F.lit(116444736000000000)) / F.lit(10_000_000.0))


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(n * 100 / total).cast("int")).otherwise(0)


def preview(text: Column, limit: int = PREVIEW_CHARS) -> tuple[Column, Column]:
    """The first ``limit`` characters, and whether some were cut."""
    return F.substring(text, 1, limit), F.length(text) > limit


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def find_count(text: Column, term: str) -> Column:
    """Occurrences that don't overlap, without case."""
    return F.regexp_count(F.lower(text), F.lit(re.escape(term.lower()))) if term else F.lit(0)


_PART = re.compile(r'"(?P<quoted>[^"]*)"|(?i:\bnear)\s*\((?P<near>[^)]*)\)|(?P<word>(?:[^\s"^()]|"(?![^"]*"))+)')


def highlight_terms(query: str) -> list[str]:
    """The words and quoted phrases of a query that a preview marks: phrases first, then words inside NEAR, then the rest.

    One pass over the query's parts; operators, distances inside NEAR and trailing stars mark nothing.
    """
    found: dict[str, list[str]] = {"quoted": [], "near": [], "word": []}
    for part in _PART.finditer(query):
        kind, body = part.lastgroup, part[part.lastgroup]
        if kind == "quoted":
            found[kind].append(body.strip())
        elif kind == "near":
            found[kind] += [w.rstrip("*") for w in body.replace(",", " ").split() if not w.rstrip("*").isdigit()]
        elif body.upper() not in ("AND", "OR", "NOT"):
            found[kind].append(body.rstrip("*"))
    return [t for kind in found.values() for t in kind if t]


#: Where a preview scrolls to.
FIRST_MATCH = '<a name="first_match"></a>'


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>", limit: int = MAX_HIGHLIGHTS, anchor: str = "") -> Column:
    """Escaped text with the first ``limit`` matches of any term marked, and line ends as <br>; ``anchor`` goes before the first mark.

    One alternation over all terms, so no term matches inside another's markup.
    """
    escapes = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
    escaped = html_escape(text)
    forms = ["".join(escapes.get(c, c) for c in t) for t in terms]
    if forms:
        pattern = "(?is)(" + "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True)) + ")"
        head = F.regexp_extract(escaped, f"(?is)^((?:.*?{pattern[5:]}){{{limit}}})", 1)
        marked = lambda x: F.regexp_replace(x, pattern, f"{before}$1{after}")
        over = F.regexp_count(escaped, F.lit(pattern)) > limit
        escaped = F.when(over, F.concat(marked(head), F.substring(escaped, F.length(head) + 1, F.length(escaped)))).otherwise(marked(escaped))
        if anchor:
            at = F.locate(before, escaped)  # markup is the only "<" of an escaped text
            escaped = F.when(at > 0, F.concat(F.substring(escaped, F.lit(1), at - 1), F.lit(anchor), F.substring(escaped, at, F.length(escaped)))).otherwise(escaped)
    return F.replace(escaped, F.lit("\n"), F.lit("<br>"))
