"""Rule bitmask ledger: every quality rule is evaluated once per document.

``measure`` scans each whole text once and ``ledger`` stores, beside the
measurements, one bit per failed rule.  Policies are versioned bit masks over that
ledger, so a policy change, its rejections and its ablations never touch a text
again: they are bitwise expressions and one aggregation over the distinct masks.

Null and empty texts have zero words and fail ``few_words``.  Rows are independent:
repeated rows give equal rows, there are no ties, null ids are kept, columns other than the
id and the text are ignored.  A very long text is scanned whole, alone in its chunk.  An empty
table gives an empty one.  An id column named like a measure is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import NONSPACE, keyed, scans, windows

WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_POINTS = NONSPACE.copy()
_POINTS[0x80:0xC0] = False  # continuation bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> whether a row of measurements fails it.  A rule's bit is its place here: append only.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("few_words", "repeated_windows")
#: Policy version -> names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines"),
}


def rule_mask(names: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def _repeats(key: np.ndarray) -> np.ndarray:
    """Marks the items whose key occurs twice or more."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: np.zeros(batch.num_rows, np.int64) for name in MEASURES}
        for lo, hi, scan in scans(batch.column(1)):
            starts, ends, owner = scan.spans(NONSPACE)
            out["n_words"][lo:hi] = np.bincount(owner, minlength=scan.n)
            out["word_chars"][lo:hi] = scan.count_in(_POINTS)
            out["n_symbols"][lo:hi] = scan.count_in(_SYMBOLS)
            run, first = windows(scan.hashes(starts, ends), owner, WINDOW)
            covered = np.zeros(len(starts) + 1, np.int64)
            repeated = first[_repeats(keyed(run, owner[first]))]
            np.add.at(covered, repeated, 1)
            np.add.at(covered, repeated + WINDOW, -1)
            inside = np.cumsum(covered)[:-1] > 0
            out["n_repeat_words"][lo:hi] = np.bincount(owner[inside], minlength=scan.n)

            starts_l, ends_l, owner_l = scan.lines()
            word = np.searchsorted(starts, starts_l)
            full = np.append(starts, len(scan.data) + 1)[word] < ends_l
            starts_l, ends_l, owner_l = starts_l[full], ends_l[full], owner_l[full]
            out["n_lines"][lo:hi] = np.bincount(owner_l, minlength=scan.n)
            key = keyed(scan.hashes(starts_l, ends_l), owner_l)
            later = np.ones(len(key), bool)
            later[np.unique(key, return_index=True)[1]] = False
            out["n_dup_lines"][lo:hi] = np.bincount(owner_l[later], minlength=scan.n)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n]) for n in MEASURES)], names=[batch.schema.names[0], *MEASURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and MEASURES (long) of every row."""
    if id_col in (*MEASURES, "failed_rules"):
        raise ValueError(f"{id_col} is the name of a measure: rename the id column")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_measure, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with ``failed_rules`` (long): bit i is set if the i-th rule of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed_rules", mask)


def passes(policy: str, mask: str = "failed_rules") -> Column:
    return F.col(mask).bitwiseAND(F.lit(rule_mask(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str, mask: str = "failed_rules") -> DataFrame:
    """For each rule of the policy: rows failing it, and rows that would pass without it.

    One aggregation by the policy's bits (at most 2^rules groups, combined before the
    shuffle); the per-rule sums run over those few groups.
    """
    groups = book.groupBy(F.col(mask).bitwiseAND(F.lit(rule_mask(POLICIES[policy])).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(rule_mask((n,))).cast("long").alias("bit")) for n in POLICIES[policy]))
    rows = groups.select("bits", "n", F.explode(rules).alias("r"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )
