"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block; blocks are
concatenated to one string:

    <|im_start|>role\\nfirst text<|im_next|>second text<|im_end|>\\n

Control strings inside texts and roles are escaped by a backslash after their "<" (one more where there are some
already) and line ends inside roles by a mark of their own, so ``parse`` gives back every turn, merged or not.  ``loss_spans``
are the code points of the escaped texts of the roles that are learned; ``under_mask`` reads them.

Turns go by ``turn``, nulls first; ties by role, then by text, both as escaped.  Null roles and texts count as empty;
rows with a null id form a conversation of their own; repeated rows are turns of their own.  Empty texts have empty
spans.  Other columns are ignored; an empty table gives no rows.  A conversation becomes one value, so its text must fit in one
task (and in 2 GB); its rows combine to arrays before the shuffle.  Work grows in proportion to a conversation's text times a 512th of its turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, NEWLINE = "<|im_start|>", "<|im_next|>", "<|im_end|>", "<|im_line|>"
#: Running sums and cuts go by so many array elements at once.
CHUNK = 512


def escape(text: Column) -> Column:
    """No "<|" is left: a backslash goes between the two, one more where there are some already."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _join(parts: Column, between: str = "") -> Column:
    return F.array_join(parts, between)


def merge_turns(turns: Column) -> Column:
    """array<struct<role, texts>>: one for each run of adjacent turns (array<struct<role, text, ...>>) of one role."""
    places = F.sequence(F.lit(1), F.size(turns))
    begins = F.filter(places, lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))

    def run(starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(turns) + 1)
        return F.transform(starts, lambda at, j: F.struct(F.get(turns, at - 1)["role"].alias("role"), F.transform(F.slice(turns, at, end(j) - at), lambda t: t["text"]).alias("texts")))

    return _let(begins, run)


def _chunks(values: Column) -> Column:
    n = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda c: F.slice(values, c * CHUNK + 1, CHUNK)))


def sums_before(values: Column) -> Column:
    """Each element's sum of the elements before it (array<long>), by chunks, so that a long array isn't copied for each element."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def inside(chunk: Column, at: Column) -> Column:
        start = F.struct(at.alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(chunk, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def by_chunk(chunks: Column) -> Column:
        return _let(F.transform(chunks, total), lambda totals: F.flatten(F.transform(chunks, lambda chunk, c: inside(chunk, total(F.slice(totals, 1, c))))))

    return F.coalesce(_let(_chunks(values), by_chunk), F.array().cast("array<long>"))


def _segments(runs: Column, loss_roles: tuple[str, ...]) -> Column:
    """One struct a turn: code points of marks before its text, of its text, of marks behind it, and whether it is learned."""

    def of_run(run: Column) -> Column:
        head = F.length(run["role"]) + len(START) + 1
        last = F.size(run["texts"]) - 1
        return F.transform(
            run["texts"],
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(len(NEXT)).cast("long").alias("before"), F.length(t).cast("long").alias("n"),
                F.when(i == last, len(END) + 1).otherwise(0).cast("long").alias("after"), run["role"].isin(*loss_roles).alias("learned"),
            ),
        )

    return F.flatten(F.transform(runs, of_run))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: its id, ``formatted``, ``loss_spans`` (array<struct<start, n>> in code points from 0) and ``n_blocks``."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), _escape_role(of(role_col)).alias("role"), escape(of(text_col)).alias("text"))
    turns = rows.select(F.col(id_col), turn.alias("t")).groupBy(id_col).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    runs = turns.select(id_col, merge_turns(F.col("turns")).alias("runs"))
    block = lambda r: F.concat(F.lit(START), r["role"], F.lit("\n"), _join(r["texts"], NEXT), F.lit(END + "\n"))
    marked = tuple(re.sub(r"<(\\*)\|", r"<\1\\|", role).replace("\n", NEWLINE) for role in loss_roles)
    joined = runs.select(id_col, _join(F.transform("runs", block)).alias("formatted"), F.size("runs").cast("long").alias("n_blocks"), _segments(F.col("runs"), marked).alias("segments"))
    starts = joined.select("*", sums_before(F.transform("segments", lambda s: s["before"] + s["n"] + s["after"])).alias("starts"))
    spans = F.transform("segments", lambda s, i: F.when(s["learned"], F.struct((F.get("starts", i) + s["before"]).alias("start"), s["n"].alias("n"))))
    return starts.select(id_col, "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), "n_blocks")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted string was made of."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 2 - len(END))
        return F.transform(F.split(body, re.escape(NEXT), -1), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, re.escape(START), -1), lambda b: b != ""), turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """array<string>: the text of each span (in order, not overlapping), unescaped.  A chunk of spans is cut out first, so that a long string isn't read for each span."""

    def of_chunk(chunk: Column) -> Column:
        base = F.get(chunk, F.lit(0))["start"]
        last = F.get(chunk, F.size(chunk) - 1)
        piece = F.substring(formatted, (base + 1).cast("int"), (last["start"] + last["n"] - base).cast("int"))
        return _let(piece, lambda p: F.transform(chunk, lambda s: unescape(F.substring(p, (s["start"] - base + 1).cast("int"), s["n"].cast("int")))))

    return F.coalesce(F.flatten(F.transform(_chunks(spans), of_chunk)), F.array().cast("array<string>"))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from ``format_conversations``: turns and learned text as counts and SHA-256."""
    read = formatted.select(id_col, "formatted", "n_blocks", parse(F.col("formatted")).alias("turns"), _join(under_mask(F.col("formatted"), F.col("loss_spans"))).alias("learned"))
    spelled = _join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )
