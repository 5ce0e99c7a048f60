"""Tokens as the full-text index sees them, by built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that got their case after Unicode 6.1, which the index's tokenizer knows; it leaves them as they are.
_NEWER = (
    (0x37F, 0x37F), (0x528, 0x52F), (0x13F8, 0x13FD), (0x1C80, 0x1CBF), (0x2C2F, 0x2C2F), (0xA698, 0xA69B), (0xA796, 0xA79F), (0xA7AB, 0xA7FF), (0xAB70, 0xABBF),
    (0x104B0, 0x104D3), (0x10570, 0x10595), (0x10C80, 0x10CB2), (0x118A0, 0x118BF), (0x16E40, 0x16E5F), (0x1E900, 0x1E921),
)


def _folds() -> tuple[dict[str, str], str]:
    """Characters that the index stores as others, and the combining marks that it drops.

    Case is folded character by character; a letter that decomposes to an ASCII letter and exactly one mark loses it.
    The marks so lost are also dropped where they stand alone; all other marks separate tokens.
    """
    table, marks = {}, set()
    for point in range(0x41, 0x1E944):
        c = chr(point)
        if unicodedata.category(c)[0] not in "LN" or any(a <= point <= b for a, b in _NEWER):
            continue
        folded = c.casefold() if len(c.casefold()) == 1 else c.lower() if len(c.lower()) == 1 else c
        parts = unicodedata.normalize("NFD", c if len(c.lower()) > 1 else folded)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            folded = parts[0].lower()
            marks.add(parts[1])
        if folded != c:
            table[c] = folded
    return table, "".join(sorted(marks))


_FOLDS, _MARKS = _folds()
_FROM, _TO = "".join(_FOLDS) + _MARKS, "".join(_FOLDS.values())  # what has no counterpart is dropped


def fold(x: Column) -> Column:
    """Folded case and no diacritics, in one pass; letters that only look accented (ß, œ, ligatures) or have two marks stay."""
    return F.translate(x, _FROM, _TO)


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the folded text, in order; null counts as empty."""
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def token_text(x: Column) -> Column:
    """The tokens as one string, each followed by a space and the first also preceded by one: phrases become substrings."""
    return F.concat(F.lit(" "), F.array_join(F.transform(tokens(x), lambda t: F.concat(t, F.lit(" "))), ""))


def n_tokens(joined: Column) -> Column:
    return F.regexp_count(joined, F.lit(" ")) - 1


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold_constant(text: str) -> list[str]:
    """The tokens of a query constant."""
    folded = text.translate(str.maketrans(_FOLDS | dict.fromkeys(_MARKS)))
    held = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded)
    return [t for t in held.split(" ") if t]
