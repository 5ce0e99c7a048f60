"""Change-journal records to catalog updates, as one pure function for batches and streams.

Records: drive, journal_id, usn, file_ref, reason (bits).  Within a batch the last record
of a file decides; a batch may be replayed, so delivery is at least once and applying
it twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.paths import join_folders
from ..operators import catalog as cat
from ..operators.staging import discard, staged
from .store import CatalogStore, next_offsets

# Reason bits of the journal.
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION = 0x1, 0x2, 0x4
FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000
REASON_MASK = DATA_OVERWRITE | DATA_EXTEND | DATA_TRUNCATION | FILE_CREATE | FILE_DELETE | RENAME_OLD | RENAME_NEW
RECORD = "drive string, journal_id long, usn long, file_ref long, reason int"


def relevant(records: DataFrame) -> DataFrame:
    return records.where(F.col("reason").bitwiseAND(F.lit(REASON_MASK)) != 0)


def reason_flags(reason: Column) -> Column:
    names = {"data_overwrite": DATA_OVERWRITE, "data_extend": DATA_EXTEND, "data_truncation": DATA_TRUNCATION, "file_create": FILE_CREATE, "file_delete": FILE_DELETE, "rename_old": RENAME_OLD, "rename_new": RENAME_NEW}
    return F.struct(*((reason.bitwiseAND(F.lit(bit)) != 0).alias(n) for n, bit in names.items()))


def last_events(records: DataFrame) -> DataFrame:
    """drive, file_ref, usn, reason and decision (delete or update) of each file's last record."""
    last = records.groupBy("drive", "file_ref").agg(F.max("usn").alias("usn"), F.max_by("reason", "usn").alias("reason"))
    return last.withColumn("decision", F.when(F.col("reason").bitwiseAND(F.lit(FILE_DELETE)) != 0, "delete").otherwise("update"))


def change_counts(records: DataFrame) -> DataFrame:
    """Per drive: files updated and deleted."""
    return last_events(records).groupBy("drive").agg(F.count_if(F.col("decision") == "update").alias("n_updated"), F.count_if(F.col("decision") == "delete").alias("n_deleted"))


def apply_changes(catalog: DataFrame, records: DataFrame, present: DataFrame, is_excluded: Callable[[Column], Column] | None = None) -> DataFrame:
    """The catalog after a batch.

    present: drive, file_ref, path, name, size, modified and is_dir of files as they are now; what it doesn't hold can't be
    resolved and keeps its row.  Files now at an excluded path leave the catalog.
    """
    gone, updates = batch_changes(records, present, is_excluded)
    return cat.upsert(cat.remove_refs(catalog, gone), updates)


def batch_changes(records: DataFrame, present: DataFrame, is_excluded: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(drive, file_ref of rows that leave the catalog, catalog rows with ``seq`` that replace those of their refs)."""
    events = last_events(relevant(records))
    deleted = events.where(F.col("decision") == "delete")
    facts = present.select("drive", "file_ref", "path", "name", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("modified", F.lit(0.0)).alias("modified"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    updates = events.where(F.col("decision") == "update").join(facts, ["drive", "file_ref"]).withColumnRenamed("usn", "seq")
    gone = deleted.select("drive", "file_ref")
    if is_excluded is not None:
        out = F.coalesce(is_excluded(F.col("path")), F.lit(False))
        gone = gone.unionByName(updates.where(out).select("drive", "file_ref"))
        updates = updates.where(~out)
    return gone, updates


def journal_metadata(records: DataFrame) -> DataFrame:
    """drive, journal_id, lowest_usn and next_usn of each drive's newest journal, from the records that it still holds."""
    each = records.groupBy("drive", "journal_id").agg(F.min("usn").alias("lowest_usn"), (F.max("usn") + 1).alias("next_usn"))
    return each.groupBy("drive").agg(F.max_by(F.struct("journal_id", "lowest_usn", "next_usn"), "journal_id").alias("j")).select("drive", "j.*")


def catchup_ranges(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """drive, first_usn and next_usn that a snapshot lacks: the journals agree and it is behind."""
    now = current.select("drive", F.col("journal_id").alias("c_journal"), F.col("next_usn").alias("c_next"))
    rows = snapshot.join(now, "drive").where((F.col("journal_id") == F.col("c_journal")) & (F.col("next_usn") < F.col("c_next")))
    return rows.select("drive", F.col("next_usn").alias("first_usn"), F.col("c_next").alias("next_usn"))


def expired(offsets: DataFrame, journals: DataFrame) -> DataFrame:
    """Drives that need a full rescan: another journal, or an offset before the lowest usn kept.  journals: drive, journal_id, lowest_usn."""
    j = journals.select("drive", F.col("journal_id").alias("j_id"), "lowest_usn")
    return offsets.join(j, "drive").where((F.col("journal_id") != F.col("j_id")) | (F.col("next_usn") < F.col("lowest_usn"))).select("drive")


def catch_up(catalog: DataFrame, offsets: DataFrame, journals: DataFrame, records: DataFrame, listing: DataFrame, present: DataFrame, is_excluded: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, one row a drive with ``action`` and ``first_usn``) after a time without following the journals.

    journals: drive, journal_id, lowest_usn and next_usn as they are now.  listing: full listings (catalog columns) of drives, each
    with ``since_usn``, the journal's end when it began.  A drive whose offset is still in its journal is ``caught up``: its records since the
    offset are applied.  One whose journal is another, or no longer holds its offset, is ``rescanned``: its rows are those of the listing,
    to which the records of the meantime, since the listing began, are applied.  Drives with nothing new are ``current``; those
    without a journal, or without the listing they need, are ``left`` as they are.
    """
    j = journals.select("drive", F.col("journal_id").alias("j_id"), "lowest_usn", F.col("next_usn").alias("j_next"))
    since = listing.groupBy("drive").agg(F.min("since_usn").alias("since_usn"))
    known = catalog.select("drive").unionByName(listing.select("drive")).distinct().join(offsets.select("drive", "journal_id", "next_usn"), "drive", "left").join(j, "drive", "left").join(since, "drive", "left")
    held = (F.col("journal_id") == F.col("j_id")) & (F.col("next_usn") >= F.col("lowest_usn"))
    action = F.when(F.col("j_id").isNull(), "left").when(held & (F.col("next_usn") >= F.col("j_next")), "current").when(held, "caught up").when(F.col("since_usn").isNull(), "left").otherwise("rescanned")
    first = F.when(F.col("action") == "caught up", F.col("next_usn")).when(F.col("action") == "rescanned", F.col("since_usn"))
    plan = staged(known.withColumn("action", action).select("drive", "action", "j_id", first.alias("first_usn")), "catch-up")  # a row a drive
    rescanned = plan.where("action = 'rescanned'").select("drive")
    base = catalog.select(*cat.CATALOG).join(rescanned, "drive", "left_anti").unionByName(listing.select(*cat.CATALOG).join(rescanned, "drive", "left_semi"))
    new = records.join(plan.where("first_usn IS NOT NULL"), "drive").where((F.col("usn") >= F.col("first_usn")) & (F.col("journal_id") == F.col("j_id")))
    return apply_changes(base, new.select(*records.columns), present, is_excluded), plan.select("drive", "action", "first_usn")


def route_changes(paths: DataFrame, folders: DataFrame, sep: str = "/") -> DataFrame:
    """path and folder for every registered folder that a changed path is or lies below."""
    return join_folders(paths.select("path"), "path", folders.select(F.col("path").alias("folder")), "folder", sep)


def pending_by_folder(paths: DataFrame, folders: DataFrame, sep: str = "/") -> DataFrame:
    """folder and its number of distinct changed paths."""
    return route_changes(paths, folders, sep).groupBy("folder").agg(F.count_distinct("path").alias("n_pending"))


def follow(records: DataFrame, store: CatalogStore, present: Callable[[], DataFrame], checkpoint: str, is_excluded: Callable[[Column], Column] | None = None, *, available_now: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Keeps the store's catalog current from a stream of records; batch n makes version n of version n - 1, its journal offsets included."""

    def one_batch(batch: DataFrame, number: int) -> None:
        seen = staged(batch, "batch")  # the source is read once
        gone, updates = batch_changes(seen, present(), is_excluded)
        updates = staged(updates, "updates")
        store.apply(number, gone, updates, next_offsets(seen))
        discard(seen, updates)

    writer = records.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def running_pending(paths: DataFrame, folders: DataFrame, sep: str = "/") -> DataFrame:
    """Each folder's number of distinct changed paths over a stream of paths; the state holds a (folder, path) once."""
    return route_changes(paths, folders, sep).dropDuplicates(["folder", "path"]).groupBy("folder").agg(F.count("*").alias("n_pending"))


class _Pending(StatefulProcessor):
    """The changed paths of one (folder, part) since its last drain, as the entries of a map."""

    def init(self, handle) -> None:
        self.paths = handle.getMapState("paths", "path string", "usn long")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timer_values):
        n = self.size.get()[0] if self.size.exists() else 0
        for row in sorted(rows, key=lambda r: r["usn"]):
            if row["path"] is None:
                self.paths.clear()
                n = 0
            elif not self.paths.containsKey((row["path"],)):
                self.paths.updateValue((row["path"],), (row["usn"],))
                n += 1
        if n:
            self.size.update((n,))
        else:
            self.size.clear()
        yield Row(folder=key[0], part=key[1], n_pending=n)


def drained_pending(events: DataFrame, folders: DataFrame, sep: str = "/", parts: int = 16) -> DataFrame:
    """folder, part and n_pending whenever they change, over a stream of events (usn, path, drained).

    A row with ``drained`` (a folder) empties that folder's pending set; all others add ``path`` to the folders it is or lies in.
    Within a batch events go by usn; batches come in order.  A folder's paths are dealt by hash over ``parts`` states, each of
    which the drain reaches, so that one busy folder isn't one key; what isn't pending takes no state.  Sum n_pending over parts.
    """
    routed = join_folders(events.where("drained IS NULL").select("usn", "path"), "path", folders.select(F.col("path").alias("folder")), "folder", sep)
    adds = routed.select("usn", "folder", "path", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part"))
    drains = events.where("drained IS NOT NULL").select("usn", F.col("drained").alias("folder"), F.lit(None).cast("string").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return adds.unionByName(drains).groupBy("folder", "part").transformWithState(_Pending(), "folder string, part int, n_pending long", "Update", "None")
