"""Binary records of file tables and change journals.

Fixed offsets are read by built-in expressions; the two formats with inner loops (file
records, data runs) are small decoders run over Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.present import filetime_to_unix

# 100 ns ticks from 1601 to 1970, and attribute types of a file record.
_EPOCH_TICKS = 116444736000000000
_STANDARD, _FILE_NAME, _DATA, _END = 0x10, 0x30, 0x80, 0xFFFFFFFF
# Which of a file's names is shown, by namespace (Win32, Win32 and DOS, POSIX, DOS).
_NAMESPACE_RANK = {1: 4, 3: 3, 0: 2, 2: 1}


def _le(data: Column, offset: int, n: int) -> Column:
    """The unsigned number of n bytes at a fixed offset, lowest first; null from 2^63 on."""
    pairs = F.regexp_replace(F.reverse(F.hex(F.substring(data, offset + 1, n))), "(.)(.)", "$2$1")
    return F.conv(pairs, 16, 10).try_cast("long")


def journal_records(rows: DataFrame, data_col: str = "record") -> DataFrame:
    """file_ref, parent_ref, attributes, reason, name and modified of version 2 journal records (binary); unsound ones are dropped."""
    data = F.col(data_col)
    length, offset = _le(data, 56, 2), _le(data, 58, 2)
    sound = rows.where((F.length(data) >= 60) & (offset + length <= F.length(data)) & (length > 0))
    raw = F.substr(data, (offset + 1).cast("int"), length.cast("int"))
    return sound.select(
        _le(data, 8, 6).alias("file_ref"), _le(data, 16, 6).alias("parent_ref"),  # 48 bits; a sequence number follows
        _le(data, 52, 4).alias("attributes"), _le(data, 40, 4).alias("reason"), _le(data, 24, 8).alias("usn"),
        F.decode(raw, "UTF-16LE").alias("name"), filetime_to_unix(_le(data, 32, 8)).alias("modified"),
    )


def split_buffer(data: bytes) -> tuple[int, list[bytes]]:
    """The cursor at the head of a journal buffer, and its length-prefixed records up to a bad length."""
    if len(data) < 8:
        return 0, []
    out, at = [], 8
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if n == 0 or at + n > len(data):
            break
        out.append(data[at : at + n])
        at += n
    return int.from_bytes(data[:8], "little"), out


def journal_buffers(rows: DataFrame, data_col: str = "buffer") -> DataFrame:
    """next_usn and record: a row for each record of the buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(cursor, r) for cursor, records in map(split_buffer, batch.column(0).to_pylist()) for r in records]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], names=["next_usn", "record"])

    return rows.select(data_col).where(F.col(data_col).isNotNull()).mapInArrow(run, "next_usn long, record binary")


def data_runs(data: bytes) -> list[tuple[int, int]]:
    """(first cluster, clusters) of a run list; sparse runs are skipped, a run past the end stops it."""
    out, at, cluster = [], 0, 0
    while at < len(data) and data[at]:
        n, m = data[at] & 15, data[at] >> 4
        body = data[at + 1 : at + 1 + n + m]
        if n == 0 or len(body) < n + m:
            break
        if m:
            cluster += int.from_bytes(body[n:], "little", signed=True)
            out.append((cluster, int.from_bytes(body[:n], "little")))
        at += 1 + n + m
    return out


def unprotected(record: bytes, sector: int) -> bytes | None:
    """The record with its sectors' last two bytes restored; None if a sector doesn't carry the record's mark."""
    if len(record) < 48:
        return None
    offset, count = struct.unpack_from("<HH", record, 4)
    if count < 2 or offset + 2 * count > len(record):
        return None
    fixed, mark = bytearray(record), record[offset : offset + 2]
    for k, end in enumerate(range(sector, len(record) + 1, sector), 1):
        if k >= count:
            break
        if record[end - 2 : end] != mark:
            return None
        fixed[end - 2 : end] = record[offset + 2 * k : offset + 2 * k + 2]
    return bytes(fixed)


def _attributes(record: bytes) -> Iterator[tuple[int, bytes]]:
    at = struct.unpack_from("<H", record, 20)[0]
    while at + 16 <= len(record):
        kind, n = struct.unpack_from("<II", record, at)
        if kind in (0, _END) or n < 16 or at + n > len(record):
            return
        yield kind, record[at : at + n]
        at += n


def file_record(record: bytes, sector: int = 512) -> tuple[int, str, bool, int, float] | None:
    """parent_ref (48 bits), name, is_dir, size and modified of a base record in use; None for others and for damaged ones."""
    if record[:4] != b"FILE" or (record := unprotected(record, sector)) is None:
        return None
    flags = struct.unpack_from("<H", record, 22)[0]
    if not flags & 1 or int.from_bytes(record[32:38], "little"):
        return None
    names, size, modified = [], 0, 0.0
    for kind, a in _attributes(record):
        resident, unnamed = a[8] == 0, a[9] == 0
        body = a[struct.unpack_from("<H", a, 20)[0] :] if resident and len(a) >= 22 else b""
        if kind == _STANDARD and len(body) >= 16:
            ticks = struct.unpack_from("<Q", body, 8)[0]
            modified = (ticks - _EPOCH_TICKS) / 1e7 if ticks > _EPOCH_TICKS else modified
        elif kind == _FILE_NAME and len(body) >= 66 and len(body) >= 66 + 2 * body[64]:
            text = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "ignore")
            names.append((_NAMESPACE_RANK.get(body[65], 0), -len(names), text, int.from_bytes(body[:6], "little")))
        elif kind == _DATA and unnamed:
            size = struct.unpack_from("<I", a, 16)[0] if resident else struct.unpack_from("<Q", a, 48)[0] if len(a) >= 56 else size
    if not names or not max(names)[2]:
        return None
    _, _, name, parent = max(names)
    return parent, name, bool(flags & 2), size, modified


def file_records(rows: DataFrame, ref_col: str = "file_ref", data_col: str = "record", sector: int = 512) -> DataFrame:
    """file_ref, parent_ref, name, is_dir, size and modified of raw file records; what isn't a base record in use is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64()]
        for batch in batches:
            found = [(ref, *r) for ref, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data and (r := file_record(data, sector))]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file_ref", "parent_ref", "name", "is_dir", "size", "modified"])

    return rows.select(F.col(ref_col).cast("long"), data_col).mapInArrow(run, "file_ref long, parent_ref long, name string, is_dir boolean, size long, modified double")


def table_image(spark, path: str, record_bytes: int = 1024, range_bytes: int = 32 << 20) -> DataFrame:
    """file_ref and record of a dumped file table: fixed-length records, of which each task reads ranges where they lie."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    n = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen() // record_bytes
    step = max(1, range_bytes // record_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                with store.open_input_file(inner) as data:
                    data.seek(first * record_bytes)
                    found = data.read(min(step, n - first) * record_bytes)
                records = [found[k : k + record_bytes] for k in range(0, len(found) - record_bytes + 1, record_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(records)), pa.int64()), pa.array(records, pa.binary())], names=["file_ref", "record"])

    starts = spark.range(0, n, step, max(1, -(-n // step)))
    return starts.mapInArrow(run, "file_ref long, record binary")
