"""Full-text conditions as composable values that compile to Columns over token strings.

A column's tokens are one string, as ``functions.text.token_text`` makes it, so a phrase is
a substring test that stays in generated code and reads the text once.

``word``, ``prefix``, ``phrase``, ``near`` and ``first`` make leaves; ``&``, ``|`` and ``-``
are AND, OR and AND NOT; ``leaf.within("name")`` restricts a leaf to one column.
``plain`` is the search box's route for ordinary words: each is a prefix, all are
required.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold_constant, let

Tokens = dict[str, Column]


class Query:
    def __and__(self, other: Query) -> Query:
        return _Both(self, other)

    def __or__(self, other: Query) -> Query:
        return _Either(self, other)

    def __sub__(self, other: Query) -> Query:
        return _Without(self, other)

    def matches(self, tokens: Tokens) -> Column:
        raise NotImplementedError

    def scored(self) -> list[Query]:
        """The leaves that count for the rank; what is excluded doesn't."""
        return [self]

    def leaves(self) -> list[Phrase | Near]:
        """The distinct phrases and NEARs of the condition."""
        return [self]

    def counted(self) -> list[tuple[Phrase | NearHit, Query]]:
        """What counts for the rank, each with the condition under which it does."""
        return [(leaf, self) for leaf in self.scored()]

    def within(self, *columns: str) -> Query:
        raise NotImplementedError


@dataclasses.dataclass(frozen=True)
class Phrase(Query):
    """Consecutive tokens of one column; with ``prefix`` the last one is only begun."""

    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] | None = None

    def within(self, *columns: str) -> Phrase:
        return dataclasses.replace(self, columns=columns)

    def among(self, tokens: Tokens) -> Tokens:
        return {k: v for k, v in tokens.items() if self.columns is None or k in self.columns}

    @property
    def needle(self) -> str:
        return " " + " ".join(self.terms) + ("" if self.prefix else " ")

    def _in(self, toks: Column) -> Column:
        return F.startswith(toks, F.lit(self.needle)) if self.initial else F.contains(toks, F.lit(self.needle))

    def matches(self, tokens: Tokens) -> Column:
        return reduce(lambda a, b: a | b, [self._in(t) for t in self.among(tokens).values()], F.lit(False))

    def hits(self, tokens: Tokens) -> Column:
        """Occurrences over all its columns (int); they may overlap."""
        counts = [self._in(t).cast("int") if self.initial else F.regexp_count(t, F.lit(f"(?={self.needle})")) for t in self.among(tokens).values()]
        return reduce(lambda a, b: a + b, counts, F.lit(0))

    def starts(self, array: Column) -> Column:
        """Positions (from 0) at which the phrase starts in an array of tokens."""
        n = len(self.terms)
        places = F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>"))
        same = lambda i, k: F.startswith(F.get(array, i + k), F.lit(self.terms[k])) if self.prefix and k == n - 1 else F.get(array, i + k) == self.terms[k]
        found = F.filter(places, lambda i: reduce(lambda a, b: a & b, [same(i, k) for k in range(n)]))
        return F.filter(found, lambda i: i == 0) if self.initial else found


@dataclasses.dataclass(frozen=True)
class Near(Query):
    """All phrases in one column, at most ``gap`` tokens between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    gap: int = 10

    def within(self, *columns: str) -> Near:
        return dataclasses.replace(self, phrases=tuple(p.within(*columns) for p in self.phrases))

    def scored(self) -> list[Query]:
        return [NearHit(self, k) for k in range(len(self.phrases))]

    def _clump(self, places: Column, last: Column) -> Column:
        """Whether a clump's last phrase starts at ``last``: each phrase starts there or before, at most its own length and the gap earlier."""
        held = lambda p, k: F.exists(places[k], lambda q: (q <= last) & (q >= last - len(p.terms) - self.gap))
        return reduce(lambda a, b: a & b, [held(p, k) for k, p in enumerate(self.phrases)])

    def _places(self, toks: Column, f: Callable[[Column], Column]) -> Column:
        """f of the array of the phrases' start positions, split and searched once."""
        return let(F.split(F.trim(toks), " "), lambda array: let(F.array(*(p.starts(array) for p in self.phrases)), f))

    def begins(self, places: Column) -> Column:
        """Whether there is any clump; places: an array of each phrase's start positions."""
        of = lambda k: F.exists(places[k], lambda last: self._clump(places, last))
        return reduce(lambda a, b: a | b, map(of, range(len(self.phrases))))

    def matches(self, tokens: Tokens) -> Column:
        held = [p.matches(tokens) for p in self.phrases]  # cheap, so most rows are never split
        tests = [self._places(t, self.begins) for t in self.phrases[0].among(tokens).values()]
        return reduce(lambda a, b: a & b, held) & reduce(lambda a, b: a | b, tests, F.lit(False))

    def inside(self, places: Column, k: int) -> Column:
        """Hits of phrase k that belong to a clump."""
        reach = len(self.phrases[k].terms) + self.gap
        ends = lambda q, j: F.exists(places[j], lambda last: (last >= q) & (last <= q + reach) & self._clump(places, last))
        return F.size(F.filter(places[k], lambda q: reduce(lambda a, b: a | b, [ends(q, j) for j in range(len(self.phrases))])))

    def hits_of(self, k: int, tokens: Tokens) -> Column:
        counts = [self._places(t, lambda places: self.inside(places, k)) for t in self.phrases[0].among(tokens).values()]
        return F.when(reduce(lambda a, b: a & b, [p.matches(tokens) for p in self.phrases]), reduce(lambda a, b: a + b, counts, F.lit(0))).otherwise(0)


@dataclasses.dataclass(frozen=True)
class NearHit(Query):
    """One phrase of a Near, for the rank: its document count is the plain phrase's, its hits are those in clumps."""

    near: Near
    k: int

    def matches(self, tokens: Tokens) -> Column:
        return self.near.phrases[self.k].matches(tokens)

    def hits(self, tokens: Tokens) -> Column:
        return self.near.hits_of(self.k, tokens)


@dataclasses.dataclass(frozen=True)
class _If(Query):
    """A leaf whose hits count where the condition around it holds."""

    leaf: Query
    node: Query

    def matches(self, tokens: Tokens) -> Column:
        return self.leaf.matches(tokens)

    def hits(self, tokens: Tokens) -> Column:
        return F.when(self.node.matches(tokens), self.leaf.hits(tokens)).otherwise(0)


@dataclasses.dataclass(frozen=True)
class _Both(Query):
    a: Query
    b: Query
    is_either = is_without = False

    def matches(self, tokens: Tokens) -> Column:
        return self.a.matches(tokens) & self.b.matches(tokens)

    def scored(self) -> list[Query]:
        return [_If(leaf, self) for leaf in self.a.scored() + self.b.scored()]

    def leaves(self) -> list[Phrase | Near]:
        return list(dict.fromkeys(self.a.leaves() + self.b.leaves()))

    def counted(self) -> list[tuple[Phrase | NearHit, Query]]:
        return [(leaf, self) for leaf, _ in self.a.counted() + self.b.counted()]

    def within(self, *columns: str) -> Query:
        return dataclasses.replace(self, a=self.a.within(*columns), b=self.b.within(*columns))


@dataclasses.dataclass(frozen=True)
class _Either(_Both):
    is_either = True

    def matches(self, tokens: Tokens) -> Column:
        return self.a.matches(tokens) | self.b.matches(tokens)

    def scored(self) -> list[Query]:
        return self.a.scored() + self.b.scored()

    def counted(self) -> list[tuple[Phrase | NearHit, Query]]:
        return self.a.counted() + self.b.counted()


@dataclasses.dataclass(frozen=True)
class _Without(_Both):
    is_without = True

    def matches(self, tokens: Tokens) -> Column:
        return self.a.matches(tokens) & ~self.b.matches(tokens)

    def scored(self) -> list[Query]:
        return [_If(leaf, self) for leaf in self.a.scored()]

    def counted(self) -> list[tuple[Phrase | NearHit, Query]]:
        return [(leaf, self) for leaf, _ in self.a.counted()]


def holds(query: Query, matched: dict[Query, Column]) -> Column:
    """The condition over its leaves' conditions."""
    if not isinstance(query, _Both):
        return matched[query]
    a, b = holds(query.a, matched), holds(query.b, matched)
    return a & ~b if isinstance(query, _Without) else a | b if isinstance(query, _Either) else a & b


K1, B = 1.2, 0.75
_LEAST_IDF = 1e-6


def idf_of(documents: Column, n: Column) -> Column:
    """The weight of a term that n of the documents hold; a term in most of them weighs next to nothing."""
    idf = F.ln((documents - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, F.lit(_LEAST_IDF)).otherwise(idf)


def term_rank(idf: Column, hits: Column, length: Column, average: Column) -> Column:
    """BM25 of one term in one document."""
    return idf * hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / average))


def _phrase(text: str, **options) -> Phrase:
    terms = tuple(fold_constant(text))
    if not terms:
        raise ValueError(f"no letters or digits in {text!r}")
    return Phrase(terms, **options)


def word(text: str) -> Phrase:
    """A token, or the phrase of its tokens if it has several."""
    return _phrase(text)


def phrase(text: str, *, prefix: bool = False) -> Phrase:
    return _phrase(text, prefix=prefix)


def prefix(text: str) -> Phrase:
    return _phrase(text, prefix=True)


def first(text: str) -> Phrase:
    """The column begins with these tokens."""
    return _phrase(text, initial=True)


def near(*texts: str, gap: int = 10) -> Near:
    return Near(tuple(_phrase(t) for t in texts), gap)


def plain(text: str) -> Query | None:
    """Ordinary words, each a phrase-prefix, all required; a trailing star is allowed.  None if nothing is left to search."""
    kept = ["".join(c for c in w.rstrip("*") if c.isalnum() or c in "._-") for w in text.split()]
    leaves: list[Query] = [_phrase(w, prefix=True) for w in kept if fold_constant(w)]
    return reduce(lambda a, b: a & b, leaves) if leaves else None
