"""Line dedup with a sharded minimal perfect hash.

1. Every text's lines become 128-bit keys (stripped, A-Z lower-cased, at least
   ``min_chars`` code points), once per document; one aggregation with map-side
   combining counts documents and keeps the largest id for each key.
2. The keys found in ``min_docs`` documents or more are dealt into shards by hash.
   Each shard becomes one row: the bit levels of a minimal perfect hash over its keys
   (levels of collision-free slots, ranked by popcount) and, at each key's slot, its
   64-bit fingerprint, document count and largest id.
3. Documents probe those arrays by slot and compare the fingerprint; there is no
   join of lines.  If all arrays fit ``max_broadcast_bytes`` (their exact size is
   known by then) they are broadcast; else the documents' keys are routed to the
   shards and only the verdicts come back, by document.

Null and empty texts have one empty line.  A document is a doc_id: repeated rows with
one doc_id count once, and all of them keep the line if that id is the largest.  Rows with a
null id count as one document together, hold the smallest place and so lose shared lines
unless no id holds them.  A very long text is scanned whole, alone in its chunk.  Other columns
are ignored by ``probe`` and carried by ``drop_lines``, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textscan import NONSPACE, Scan, mix, scans

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 16
MAX_BROADCAST_BYTES = 64 << 20
_GAMMA = 1.5  # slots per key and level
_NO_ID = -(1 << 63)
_BYTES_PER_KEY = 32
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def _line_keys(scan: Scan, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the lines long enough: text, line number within it, two hashes; and all texts' line counts."""
    starts, ends, owner = scan.lines()
    number = np.arange(len(starts)) - np.searchsorted(owner, owner)
    word_s, word_e, _ = scan.spans(NONSPACE)
    a, b = np.searchsorted(word_s, starts), np.searchsorted(word_e, ends, "right")
    full = a < b
    left, right = word_s[a[full]], word_e[b[full] - 1]
    points = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(_POINT[scan.data], out=points[1:])
    long = points[right] - points[left] >= min_chars
    left, right = left[long], right[long]
    lower = scan.lowered()
    return owner[full][long], number[full][long], lower.hashes(left, right, 0), lower.hashes(left, right, 1), np.bincount(owner, minlength=scan.n)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for lo, _, scan in scans(batch.column(1)):
                owner, _, h1, h2, _ = _line_keys(scan, min_chars)
                keep = np.unique(mix(h1 + mix(owner.astype(np.uint64))), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([_as_long(h1[keep]), _as_long(h2[keep]), pa.array(ids[lo + owner[keep]])], names=["h1", "h2", "id"])

    return run


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n_docs and last_id of the line keys found in at least ``min_docs`` documents."""
    keys = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_emit_keys(min_chars), "h1 long, h2 long, id long")
    held = keys.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))  # documents, not rows; a line held by many spreads by id
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id")).where(F.col("n_docs") >= min_docs)


# -- the minimal perfect hash of one shard


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and their concatenated slot bits (bool) for distinct 64-bit keys."""
    sizes, levels, rest = [], [], keys
    while len(rest):
        size = max(8, int(_GAMMA * len(rest)))
        slot = _slot(rest, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        rest = rest[~alone[slot]]
    return np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


def mph_slot(sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's slot, in 0..n-1 and distinct for the n keys it was built over; any slot or -1 for others."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    slots = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _slot(keys[todo], level, int(size))
        hit = bits[at]
        slots[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + int(size)
    return slots


_SHARD = "shard int, n long, sizes binary, bits binary, prints binary, counts binary, ids binary, more binary"


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard; a shard's rows may span batches."""

    def finish(shard: int, parts: list[pa.Table]) -> pa.RecordBatch:
        h1, h2, n, ids = (pa.concat_tables(parts).column(c).to_numpy() for c in ("h1", "h2", "n_docs", "last_id"))
        keys = h1.view(np.uint64)
        keep = np.sort(np.unique(keys, return_index=True)[1])
        late = np.setdiff1d(np.arange(len(keys)), keep)  # keys that share their first half with another, about 2^-64 a pair: listed beside the arrays
        more = np.stack([h1[late], h2[late], ids[late]], 1).astype(np.int64)
        keys, h2, n, ids = keys[keep], h2[keep], n[keep], ids[keep]
        sizes, bits = build_mph(keys)
        place = np.argsort(mph_slot(sizes, bits, keys))
        row = [shard, len(keys), sizes.tobytes(), np.packbits(bits).tobytes(), h2[place].tobytes(), n[place].astype(np.int64).tobytes(), ids[place].tobytes(), more.tobytes()]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["shard", "n", "sizes", "bits", "prints", "counts", "ids", "more"])

    current, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and shard[a] != current:
                yield finish(current, parts)
                parts = []
            current = int(shard[a])
            parts.append(table.slice(a, b - a))
    if parts:
        yield finish(current, parts)


def build_index(counts: DataFrame, n_keys: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard of about ``shard_keys`` keys, so a shard's arrays stay near 2 MB at any size of the table."""
    shards = max(1, -(-n_keys // shard_keys))
    dealt = counts.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build_shards, _SHARD)


class Shards:
    """The arrays of some shards, probed together."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.of = {}
        for r in rows:
            sizes = np.frombuffer(r["sizes"], np.int64)
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            self.of[r["shard"]] = (sizes, bits, *(np.frombuffer(r[c], np.int64) for c in ("prints", "counts", "ids")), np.frombuffer(r["more"], np.int64).reshape(-1, 3))

    def last_ids(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the index, and its largest id."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        shard = np.mod(h1.view(np.int64), self.shards)
        for s in np.unique(shard):
            if int(s) not in self.of:
                continue
            sizes, bits, prints, _, ids, more = self.of[int(s)]
            at = np.flatnonzero(shard == s)
            slot = mph_slot(sizes, bits, h1[at])
            good = slot >= 0
            good[good] = prints[slot[good]] == h2[at[good]].view(np.int64)
            found[at[good]] = True
            last[at[good]] = ids[slot[good]]
            for x, y, last_id in more:
                hit = at[(h1[at].view(np.int64) == x) & (h2[at].view(np.int64) == y)]
                found[hit], last[hit] = True, last_id
        return found, last


def _apply(batch: pa.RecordBatch, dropped_of, min_chars: int, digest: bool) -> pa.RecordBatch:
    """The batch's row structs, kept texts and line counts; dropped_of(lo, owner, number, h1, h2) marks the dropped long lines."""
    texts, n_lines, n_dropped = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    for lo, hi, scan in scans(batch.column(1)):
        owner, number, h1, h2, lines = _line_keys(scan, min_chars)
        drop = dropped_of(lo, owner, number, h1, h2)
        n_lines[lo:hi] = lines
        n_dropped[lo:hi] = np.bincount(owner[drop], minlength=scan.n)
        gone: dict[int, set[int]] = {}
        for i, k in zip(owner[drop].tolist(), number[drop].tolist(), strict=True):
            gone.setdefault(i, set()).add(k)
        for i in range(scan.n):
            text = scan.text(i)
            if i in gone:
                text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone[i])
            texts.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
    kept = pa.array(texts, pa.binary())  # not every text's bytes are UTF-8
    return pa.RecordBatch.from_arrays([batch.column(2), kept, pa.array(n_lines), pa.array(n_dropped)], names=["row", "kept", "n_lines", "n_dropped"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _probe_broadcast(handle, shards: int, min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shards(handle.value, shards)
        for batch in batches:
            ids = _ids(batch)

            def dropped(lo, owner, number, h1, h2, ids=ids):
                found, last = index.last_ids(h1, h2)
                return found & (ids[lo + owner] != last)

            yield _apply(batch, dropped, min_chars, digest)

    return run


# -- the routed way, for an index too large to broadcast


def _route_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            uid = batch.column(2).to_numpy()
            for lo, _, scan in scans(batch.column(1)):
                owner, number, h1, h2, _ = _line_keys(scan, min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(uid[lo + owner]), pa.array(ids[lo + owner]), pa.array(number), _as_long(h1), _as_long(h2)], names=["uid", "id", "number", "h1", "h2"])

    return run


def _probe_routed(shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Shards(right.to_pylist(), shards)
        left = left.combine_chunks()
        get = {c: left.column(c).to_numpy() for c in ("h1", "h2", "id", "uid", "number")}
        found, last = index.last_ids(get["h1"].view(np.uint64), get["h2"].view(np.uint64))
        gone = found & (get["id"] != last)
        return pa.table({"uid": get["uid"][gone], "number": get["number"][gone]})

    return run


def _drop_listed(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()

            def dropped(lo, owner, number, h1, h2, lists=lists):
                return np.array([lists[lo + o] is not None and n in lists[lo + o] for o, n in zip(owner.tolist(), number.tolist(), strict=True)], bool)

            yield _apply(batch, dropped, min_chars, digest)

    return run


def _probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, route_rows: int = 500_000) -> DataFrame:
    spark = docs.sparkSession
    counts = stored(line_counts(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs), "line-counts")
    n_keys = counts.count()
    shards = max(1, -(-n_keys // shard_keys))
    index = stored(build_index(counts, n_keys, shard_keys), "line-index")
    rest = [c for c in docs.columns if c != text_col]
    ready = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    out = f"row {ready.schema['row'].dataType.simpleString()}, kept binary, n_lines long, n_dropped long"
    if n_keys * _BYTES_PER_KEY <= max_broadcast_bytes:
        handle = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
        return ready.mapInArrow(_probe_broadcast(handle, shards, min_chars, digest), out)
    rows = stored(ready.withColumn("uid", F.monotonically_increasing_id()), "line-docs")
    keys = rows.select("id", "text", "uid").mapInArrow(_route_keys(min_chars), "uid long, id long, number long, h1 long, h2 long")
    keys = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    parts = stored(keys.groupBy("shard").agg(F.ceil(F.count("*") / route_rows).cast("int").alias("parts")), "line-parts")  # a hot line's shard is dealt over more groups
    keys = keys.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    gone = keys.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe_routed(shards), "uid long, number long")
    lists = gone.groupBy("uid").agg(F.collect_list("number").alias("numbers"))
    return rows.join(lists, "uid", "left").select("id", "text", "row", "numbers").mapInArrow(_drop_listed(min_chars, digest), out)


def probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """row (a struct of docs' columns but the text), kept (the text, or its SHA-256 with ``digest``), n_lines and n_dropped of every row."""
    return _probe(docs, id_col, text_col, **options).withColumn("kept", F.col("kept").cast("string"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with the shared lines gone from the text; a null text becomes an empty one."""
    rows = probe(docs, id_col, text_col, **options)
    return rows.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
