"""The catalog kept by key: hash buckets of rows, of which a batch rewrites those it touches.

Rows lie in buckets by (drive, file_ref).  Who owns a path lies in buckets by (drive, lower-case path): the ref that came there
last.  A row counts while its ref owns its path, so a file that moves onto another's path evicts it without its bucket
being touched.  Each version has one manifest row: which version each bucket was last written by, and each drive's journal
offset.  It is written last, so catalog and offsets change together; a batch is numbered by the stream, starts from the version
before its own and writes the same folders when it is replayed.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..operators import catalog as cat
from ..operators.settings import upsert_offsets
from ..operators.staging import folders_in, remove_folder

BUCKETS = 256
_ROWS = "drive string, file_ref long, path string, name string, extension string, size long, modified double, is_dir boolean"
_OWNERS = "drive string, path_key string, owner long, seq long"
_OFFSETS = "drive string, journal_id long, next_usn long"
_MANIFEST = f"version long, rows map<int, long>, owners map<int, long>, offsets array<struct<{_OFFSETS.replace(' ', ':').replace(',:', ',')}>>"
_START = -1


@dataclasses.dataclass
class Manifest:
    version: int
    rows: dict[int, int]
    owners: dict[int, int]
    offsets: list[tuple[str, int, int]]


class CatalogStore:
    """Versions of a catalog in a folder that all executors see.  The latest two can be read: a replayed batch starts from the older one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or of the last one."""
        number = version
        if version is None:
            number = max(int(name.partition("=")[2]) for name in folders_in(self.spark, f"{self.path}/manifest", written=True))
        found = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/at={number}").first()
        return Manifest(found["version"], found["rows"], found["owners"], [tuple(o) for o in found["offsets"]])

    def _load(self, table: str, schema: str, at: dict[int, int]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{table}/version={v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def _save(self, table: str, version: int, rows: DataFrame, bucket: Column, touched: list[int], at: dict[int, int]) -> dict[int, int]:
        """Writes the touched buckets' new rows; where each bucket lies then.  Buckets left without rows lie nowhere."""
        path = f"{self.path}/{table}/version={version}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        kept = {b: v for b, v in at.items() if b not in set(touched)}
        held = [int(name.partition("=")[2]) for name in folders_in(self.spark, path)]
        return kept | dict.fromkeys(held, version)

    def _touched(self, keys: DataFrame, bucket: Column) -> list[int]:
        return [r[0] for r in keys.select(bucket).distinct().collect()]  # at most ``buckets`` numbers

    def _commit(self, manifest: Manifest) -> None:
        row = (manifest.version, manifest.rows, manifest.owners, manifest.offsets)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/at={manifest.version}")

    def start(self, catalog: DataFrame, offsets: DataFrame | None = None) -> None:
        rows = catalog.select(*cat.CATALOG)
        owners = rows.select("drive", F.lower("path").alias("path_key"), F.col("file_ref").alias("owner"), F.lit(None).cast("long").alias("seq"))
        first = [tuple(r) for r in offsets.select("drive", "journal_id", "next_usn").collect()] if offsets is not None else []  # a row a drive
        self._commit(Manifest(_START, self._save("rows", _START, rows, self._bucket("drive", "file_ref"), [], {}), self._save("owners", _START, owners, self._bucket("drive", "path_key"), [], {}), first))

    def read(self, version: int | None = None) -> DataFrame:
        """The catalog of a version, or of the last one."""
        now = self.manifest(version)
        owners = self._load("owners", _OWNERS, now.owners).select(F.col("drive").alias("o_drive"), "path_key", "owner")
        rows = self._load("rows", _ROWS, now.rows)
        mine = rows.join(owners, (F.col("drive") == F.col("o_drive")) & (F.lower("path") == F.col("path_key")) & (F.col("file_ref") == F.col("owner")))
        return cat.with_lower_name(mine.select(*cat.CATALOG))

    def offsets(self, version: int | None = None) -> DataFrame:
        return self.spark.createDataFrame(self.manifest(version).offsets, _OFFSETS)

    def apply(self, version: int, gone: DataFrame, updates: DataFrame, offsets: DataFrame | None = None) -> Manifest:
        """Writes version ``version`` from the one before it.

        gone: drive, file_ref of rows that leave.  updates: catalog columns and ``seq``, one row a ref.  offsets: drive,
        journal_id, next_usn.
        """
        before = self.manifest(version - 1)
        updates = updates.where("NOT startswith(name, '$')").withColumn("extension", extension(F.col("name")))
        keys = gone.select("drive", "file_ref").unionByName(updates.select("drive", "file_ref")).distinct()
        by_ref, by_path = self._bucket("drive", "file_ref"), self._bucket("drive", "path_key")
        touched = self._touched(keys, by_ref)
        old = self._load("rows", _ROWS, {b: v for b, v in before.rows.items() if b in set(touched)}).join(keys, ["drive", "file_ref"], "left_anti")
        rows = self._save("rows", version, old.select(*cat.CATALOG).unionByName(updates.select(*cat.CATALOG)), by_ref, touched, before.rows)
        claims = updates.select("drive", F.lower("path").alias("path_key"), F.col("file_ref").alias("owner"), F.col("seq").cast("long").alias("seq"))
        at_path = self._touched(claims, by_path)
        owned = self._load("owners", _OWNERS, {b: v for b, v in before.owners.items() if b in set(at_path)}).withColumn("age", F.lit(0))
        last = owned.unionByName(claims.withColumn("age", F.lit(1))).groupBy("drive", "path_key").agg(F.max_by(F.struct("owner", "seq"), F.struct("age", "seq")).alias("r")).select("drive", "path_key", "r.owner", "r.seq")
        owners = self._save("owners", version, last, by_path, at_path, before.owners)
        done = before.offsets if offsets is None else [tuple(r) for r in upsert_offsets(self.spark.createDataFrame(before.offsets, _OFFSETS), offsets).collect()]  # a row a drive
        now = Manifest(version, rows, owners, done)
        self._commit(now)
        self._drop_unused(before, now)
        return now

    def _drop_unused(self, before: Manifest, now: Manifest) -> None:
        """Deletes what the version before ``before`` alone still named."""
        number = before.version - 1
        if f"at={number}" not in folders_in(self.spark, f"{self.path}/manifest"):
            return
        older = self.manifest(number)
        for table, old, kept in (("rows", older.rows, (before.rows, now.rows)), ("owners", older.owners, (before.owners, now.owners))):
            for bucket, version in old.items():
                if all(at.get(bucket) != version for at in kept):
                    remove_folder(self.spark, f"{self.path}/{table}/version={version}/bucket={bucket}")
        remove_folder(self.spark, f"{self.path}/manifest/at={older.version}")


def next_offsets(records: DataFrame) -> DataFrame:
    """Where each drive's journal goes on after these records."""
    last = records.groupBy("drive").agg(F.max_by("journal_id", "usn").alias("journal_id"), (F.max("usn") + 1).alias("next_usn"))
    return last.select("drive", "journal_id", "next_usn")

