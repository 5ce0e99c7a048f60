"""Repairing the structure of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's rows, a transducer of edits (Keep, Rerole, Delete,
Insert) and an acceptor of role initials (``ROLES``: ``(s?(ua)+)?``).  A composed state is (row, inserts since the last row,
role state); states are made only when a path from the end reaches them.  As rows and inserts only grow, going back
from the end is a topological order.  Weights are pairs (cost, labels) under lexicographic order.  They are summed
from the end: putting one label before two strings keeps their order, putting one behind needn't.  An inserted
row costs something, so a cheapest path comes to no role state twice without taking a row, and the transducer counts no
more inserts than that.  All edits that leave one state have labels of their own, so the first label settles ties.

Costs beyond a row depend on it only by its class (role initial, must go, truncated), so a step back over one class
from one vector of costs, less its smallest, is made once and kept: long conversations take a lookup a row.

Rows are read in order in a stream.  Each comes twice: first without its text, when only its class is kept, then with
its text, once the path is known; so a task holds some bytes a row (and a digest a distinct row) of one conversation, never
its texts.

Turns go by ``turn``, nulls first; ties by role, then by the text's MD5.  Null roles and texts count as one space.  Rows with
a null id form a conversation of their own; a repeated row is a duplicate.  Very long texts are carried
whole, one at a time.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Roles that Rerole and Insert may give, by their initials.
GIVEN = {"u": "user", "a": "assistant"}


@dataclasses.dataclass(frozen=True)
class Acceptor:
    """A deterministic machine over role initials, from state 0; a state takes at most one of the initials that edits give."""

    arcs: tuple[tuple[int, str, int], ...]
    finals: tuple[int, ...]

    @functools.cached_property
    def states(self) -> int:
        return 1 + max(max(a, b) for a, _, b in self.arcs)

    def after(self, state: int, initial: str) -> int | None:
        return next((b for a, c, b in self.arcs if a == state and c == initial), None)

    def given(self, state: int) -> tuple[str, int] | None:
        """The role that an edit can give here, and the state after it."""
        found = [(GIVEN[c], b) for a, c, b in self.arcs if a == state and c in GIVEN]
        if len(found) > 1:
            raise ValueError(f"state {state} takes more than one role that edits can give")
        return found[0] if found else None


#: (s?(ua)+)?
ROLES = Acceptor(arcs=((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)), finals=(0, 3))


@dataclasses.dataclass(frozen=True)
class RowClass:
    """All that a row's edits depend on; ``None`` as its initial: the end of the conversation."""

    initial: str | None
    must_go: bool = False
    truncated: bool = False


Edit = tuple[str, str | None]  # label, role given
Step = tuple[int, tuple[float, ...], tuple[tuple[tuple[Edit, ...], int], ...]]


@functools.lru_cache(maxsize=1 << 16)
def step_back(grammar: Acceptor, row: RowClass, beyond: tuple[float, ...]) -> Step:
    """From the costs behind a row to those before it, by role state: what was taken off them, the costs, and each state's edits and next state."""
    inserts = range(grammar.states - 1, -1, -1)
    weights: dict[tuple[int, int], tuple[float, tuple[Edit, ...], int]] = {}

    def arcs(n: int, state: int) -> Iterator[tuple[float, Edit, tuple[float, tuple[Edit, ...], int]]]:
        """The composed arcs of a state: their cost, their edit, and the weight of where they go."""
        extra = TRUNCATED_COST if row.truncated else 0
        given = grammar.given(state)
        behind = lambda to: (beyond[to], (), to)
        if row.initial is not None:
            if not row.must_go:
                kept = grammar.after(state, row.initial)
                if kept is not None:
                    yield COSTS[KEEP] + extra, (KEEP, None), behind(kept)
                if given:
                    yield COSTS[REROLE] + extra, (REROLE, given[0]), behind(given[1])
            yield COSTS[DELETE], (DELETE, None), behind(state)
        if given and (n + 1, given[1]) in weights:
            yield COSTS[INSERT], (INSERT, given[0]), weights[n + 1, given[1]]

    for n in inserts:
        for state in range(grammar.states):
            found = [(cost + w[0], edit[0], (edit, *w[1]), w[2]) for cost, edit, w in arcs(n, state) if cost + w[0] < math.inf]
            if row.initial is None and state in grammar.finals:
                found.append((0, "", (), state))
            if found:
                cost, _, edits, to = min(found, key=lambda f: f[:2])
                weights[n, state] = cost, edits, to
    costs = tuple(weights[0, s][0] if (0, s) in weights else math.inf for s in range(grammar.states))
    least = int(min(costs))
    ways = tuple(weights[0, s][1:] if (0, s) in weights else ((), s) for s in range(grammar.states))
    return least, tuple(c - least for c in costs), ways


def cheapest(classes: list[RowClass], grammar: Acceptor = ROLES) -> tuple[int, list[tuple[Edit, ...]]]:
    """The cost of the cheapest edits, and for each row the edits up to and with its own (inserts come before), then those at the end."""
    taken, beyond, ways = step_back(grammar, RowClass(None), (math.inf,) * grammar.states)
    path = [ways]
    for row in reversed(classes):
        less, beyond, ways = step_back(grammar, row, beyond)
        taken += less
        path.append(ways)
    state, edits = 0, []
    cost = taken + int(beyond[0])
    for ways in reversed(path):
        done, state = ways[state]
        edits.append(done)
    return cost, edits


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``gone``, broken by crc32(conv_id:turn) % 20: dropped rows are ``gone``, repeated ones come twice."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of(id_col), F.lit(":"), of(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(of(text_col), "[.!?]", "")).otherwise(of(text_col))
    role = F.when(kind == 4, "user").otherwise(of(role_col))
    out = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


_BLANK = r"[\x20\x09-\x0D]"
_IN = "conv_id", "pass", "turn", "role", "digest", "blank", "whole", "text"


def _twice(rows: DataFrame) -> DataFrame:
    """Each row without and with its text, a conversation's in order and in one partition; ``gone`` rows come as pass -1."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    facts = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "gone", F.unhex(F.md5(text.cast("binary"))).alias("digest"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.rlike(rf"[.!?]{_BLANK}*\z").alias("whole"))
    passes = F.when(F.col("gone"), F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = facts.withColumn("pass", F.explode(passes)).withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    return both.select(*_IN).repartition("conv_id").sortWithinPartitions("conv_id", "pass", "turn", "role", "digest")


class _Conversation:
    """One conversation as it streams by."""

    def __init__(self, conv_id: int | None, grammar: Acceptor):
        self.conv_id, self.grammar = conv_id, grammar
        self.classes: list[RowClass] = []
        self.seen: set[bytes] = set()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.role = None
        self.edits: list[tuple[Edit, ...]] | None = None
        self.at = 0

    def take(self, turn: int | None, role: str, digest: bytes, blank: bool, whole: bool) -> None:
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        key = hashlib.md5(digest + role.encode()).digest()
        again, cut = not blank and key in self.seen, False
        self.seen.add(key)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif not whole:
            self.truncated, cut = self.truncated + 1, True
        self.classes.append(_class_of(role[:1], blank or again, cut))

    def solve(self) -> None:
        if self.edits is None:
            self.cost, self.edits = cheapest(self.classes, self.grammar)
            self.seen.clear()

    def repaired(self, edits: tuple[Edit, ...], role: str = "", text: str = "") -> Iterator[tuple[str, str | None, str | None]]:
        """label, role and text of each edit; deleted rows have none."""
        for label, given in edits:
            yield label, *((given, "") if label == INSERT else (None, None) if label == DELETE else (given or role, text))

    def next_row(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        self.solve()
        self.at += 1
        return self.repaired(self.edits[self.at - 1], role, text)

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        self.solve()
        return self.repaired(self.edits[-1])

    def report(self) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost]

    def audit(self) -> str:
        return "".join(label for edits in self.edits for label, _ in edits)


@functools.lru_cache(maxsize=1 << 12)
def _class_of(initial: str, must_go: bool, truncated: bool) -> RowClass:
    return RowClass(initial, must_go, truncated)


def _stream(batches: Iterator[pa.RecordBatch], grammar: Acceptor) -> Iterator[tuple[_Conversation, Iterator, bool]]:
    """(conversation, its next edits, whether these are the last ones), in order."""
    open_: _Conversation | None = None
    for batch in batches:
        for conv_id, which, turn, role, digest, blank, whole, text in zip(*(batch.column(i).to_pylist() for i in range(len(_IN))), strict=True):
            if open_ is None or conv_id != open_.conv_id:
                if open_ is not None:
                    yield open_, open_.end(), True
                open_ = _Conversation(conv_id, grammar)
            if which == 0:
                open_.take(turn, role, digest, blank, whole)
            elif which == 1:
                yield open_, open_.next_row(role, text), False
    if open_ is not None:
        yield open_, open_.end(), True


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_DIGEST = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_repaired", pa.int64())])
#: Output batches hold so many rows, or characters of text.
_ROWS, _CHARS = 4096, 1 << 22


def _turns(grammar: Acceptor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars, at = [], 0, 0
        for conversation, edits, last in _stream(batches, grammar):
            for label, role, text in edits:
                rows.append((conversation.conv_id, at, label, role, text))
                at, chars = at + 1, chars + len(text or "")
            if len(rows) >= _ROWS or chars >= _CHARS:
                yield pa.RecordBatch.from_pylist([dict(zip(_TURNS.names, r, strict=True)) for r in rows], _TURNS)
                rows, chars = [], 0
            at = 0 if last else at
        yield pa.RecordBatch.from_pylist([dict(zip(_TURNS.names, r, strict=True)) for r in rows], _TURNS)

    return run


def _digests(grammar: Acceptor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest, n = [], hashlib.sha256(), 0
        for conversation, edits, last in _stream(batches, grammar):
            for _, role, text in edits:
                if role is not None:
                    digest.update((("\n" if n else "") + role + ":" + text).encode())
                    n += 1
            if last:
                rows.append((conversation.conv_id, *conversation.report(), conversation.audit(), digest.hexdigest(), n))
                digest, n = hashlib.sha256(), 0
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in rows], _DIGEST)
                    rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in rows], _DIGEST)

    return run


def _with_gone(rows: DataFrame) -> DataFrame:
    return rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))


def repair(rows: DataFrame, grammar: Acceptor = ROLES) -> DataFrame:
    """rows (conv_id, turn, role, text) after the cheapest edits: conv_id, position, edit, role and text, both null where a row was deleted."""
    return _twice(_with_gone(rows)).mapInArrow(_turns(grammar), "conv_id long, position long, edit string, role string, text string")


def report(rows: DataFrame, grammar: Acceptor = ROLES) -> DataFrame:
    """One row a conversation: its faults, the cost of the cheapest edits, their labels (``audit``) and the repaired text's SHA-256.

    With a column ``gone``, such rows only name their conversation.
    """
    counts = ", ".join(f"{c} long" for c in _REPORT)
    return _twice(_with_gone(rows)).mapInArrow(_digests(grammar), f"conv_id long, {counts}, audit string, repaired_sha256 string, n_repaired long")
