"""A volume image as a Spark data source: its file table's raw records, a task a range of the table.

    spark.dataSource.register(VolumeImage)
    spark.read.format("volume_image").option("path", "/images/c.img").load()   # file_ref, record

The boot sector gives the geometry, record 0 the runs of clusters that hold the table; ranges of these runs are
the partitions.  The image has to be on a file system that every executor mounts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .records import data_runs, file_records, journal_buffers, journal_records, unprotected

#: Bytes of the table that one task reads.
RANGE_BYTES = 4 << 20
_DATA, _END = 0x80, 0xFFFFFFFF


class Geometry:
    """Sector, cluster and record sizes and the table's first byte, from a boot sector."""

    def __init__(self, boot: bytes):
        self.sector = struct.unpack_from("<H", boot, 0x0B)[0]
        self.cluster = self.sector * boot[0x0D]
        size = struct.unpack_from("<b", boot, 0x40)[0]
        self.record = 1 << -size if size < 0 else size * self.cluster
        self.table = struct.unpack_from("<Q", boot, 0x30)[0] * self.cluster
        if not (self.sector and self.cluster and self.record):
            raise ValueError("no file system that this source knows")


def table_runs(record: bytes, sector: int) -> list[tuple[int, int]]:
    """The runs of the unnamed data of record 0; none if it is damaged or holds its data itself."""
    fixed = unprotected(record, sector) if record[:4] == b"FILE" else None
    at = struct.unpack_from("<H", fixed, 20)[0] if fixed else len(record)
    while fixed and at + 16 <= len(fixed):
        kind, size = struct.unpack_from("<II", fixed, at)
        if kind in (0, _END) or size < 16 or at + size > len(fixed):
            break
        if kind == _DATA and fixed[at + 8] == 1 and fixed[at + 9] == 0:
            first = struct.unpack_from("<H", fixed, at + 32)[0]
            return data_runs(fixed[at + first : at + size])
        at += size
    return []


class _Range(InputPartition):
    def __init__(self, first_ref: int, offset: int, n: int):
        self.first_ref, self.offset, self.n = first_ref, offset, n


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        with open(path, "rb") as f:
            self.geometry = g = Geometry(f.read(512))
            f.seek(g.table)
            self.runs = table_runs(f.read(g.record), g.sector)

    def partitions(self) -> list[_Range]:
        g, ref, out = self.geometry, 0, []
        step = max(1, self.range_bytes // g.record)
        for cluster, count in self.runs:
            records = count * g.cluster // g.record
            for k in range(0, records, step):
                out.append(_Range(ref + k, cluster * g.cluster + k * g.record, min(step, records - k)))
            ref += records
        return out

    def read(self, partition: _Range) -> Iterator[tuple[int, bytes]]:
        size = self.geometry.record
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            for k in range(partition.n):
                record = f.read(size)
                if len(record) < size:
                    return
                yield partition.first_ref + k, record


class VolumeImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_image"

    def schema(self) -> str:
        return "file_ref long, record binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def enumerate_volume(spark: SparkSession, path: str, drive: str) -> DataFrame:
    """drive, file_ref, parent_ref, name, is_dir, size and modified of the files on a volume image."""
    spark.dataSource.register(VolumeImage)
    sector = _Reader(path, RANGE_BYTES).geometry.sector
    raw = spark.read.format("volume_image").option("path", path).load()
    return file_records(raw, sector=sector).select(F.lit(drive.upper()).alias("drive"), "*")


def journal_listing(buffers: DataFrame, drive: str) -> DataFrame:
    """The same columns from a full listing by journal records: the last record of a file wins, and its size is unknown (0)."""
    found = journal_records(journal_buffers(buffers))
    last = found.groupBy("file_ref").agg(F.max_by(F.struct("parent_ref", "name", "attributes", "modified"), "usn").alias("r"))
    is_dir = F.col("r.attributes").bitwiseAND(F.lit(0x10)) != 0
    return last.select(F.lit(drive.upper()).alias("drive"), "file_ref", "r.parent_ref", "r.name", is_dir.alias("is_dir"), F.lit(0).cast("long").alias("size"), "r.modified")


def journal_stream(spark: SparkSession, folder: str, drive: str, journal_id: int, start_usn: int = 0) -> DataFrame:
    """A stream of change records from journal buffers that appear as files in a folder, ready for ``streaming.changes``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    found = journal_records(journal_buffers(files, "content")).where(F.col("usn") >= start_usn)
    return found.select(F.lit(drive.upper()).alias("drive"), F.lit(journal_id).cast("long").alias("journal_id"), "usn", "file_ref", F.col("reason").cast("int").alias("reason"), "parent_ref", "name")


def supported_volumes(volumes: DataFrame) -> DataFrame:
    """Fixed and removable volumes (drive, kind, file_system) with a file table this source knows."""
    return volumes.where(F.upper("file_system").eqNullSafe("NTFS") & F.lower("kind").isin("fixed", "removable"))
