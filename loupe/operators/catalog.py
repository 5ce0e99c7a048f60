"""The file catalog and the content index as tables, changed by joins.

Every function takes the present tables and returns the next ones; writers put a whole
new version beside the old one.  Keys are (drive, file_ref) and, without case, (drive,
path).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, drive, extension, extractable, join_folders, normalized, under
from .progress import Progress
from .staging import staged

SAME_TIME = 0.001
CATALOG = ["drive", "file_ref", "path", "name", "extension", "size", "modified", "is_dir"]


def _latest(rows: DataFrame, keys: list[Column | str], order: Column | str) -> DataFrame:
    """One row a key, the last by ``order``: an aggregation that combines before the shuffle."""
    names = rows.columns
    last = rows.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*names), order).alias("r"))
    return last.select("r.*")


def populate(entries: DataFrame, order: str = "seq") -> DataFrame:
    """A catalog of entries with a path and a name that doesn't start with '$'; the last row of a ref, then of a path, wins."""
    sound = entries.where("path IS NOT NULL AND path <> '' AND name IS NOT NULL AND name <> '' AND NOT startswith(name, '$')")
    rows = sound.withColumn("extension", extension(F.col("name")))
    one = _latest(_latest(rows, ["drive", "file_ref"], order), ["drive", F.lower("path")], order)
    return with_lower_name(one.select(*CATALOG))


def with_lower_name(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("name_lower", F.lower("name"))


def upsert(catalog: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Changes (catalog columns and ``order``) replace rows of their ref, and evict other refs from their path."""
    old = catalog.select(*CATALOG, F.lit(None).cast("long").alias("__seq"))
    new = changes.where("NOT startswith(name, '$')").withColumn("extension", extension(F.col("name"))).select(*CATALOG, F.col(order).cast("long").alias("__seq"))
    both = old.unionByName(new).withColumn("__seq", F.coalesce("__seq", F.lit(-(1 << 62))))
    one = _latest(_latest(both, ["drive", "file_ref"], "__seq"), ["drive", F.lower("path")], "__seq")
    return with_lower_name(one.select(*CATALOG))


def remove_refs(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    return catalog.join(refs.select("drive", "file_ref"), ["drive", "file_ref"], "left_anti")


def remove_excluded(catalog: DataFrame, is_excluded: Column) -> DataFrame:
    return catalog.where(~is_excluded)


def save_snapshot(catalog: DataFrame, path: str) -> None:
    """Overwrites the snapshot, one folder a drive."""
    catalog.select("file_ref", "path", "name", "extension", "size", "modified", "is_dir", drive(F.col("path")).alias("drive")).write.mode("overwrite").partitionBy("drive").parquet(path)


def load_snapshot(spark, path: str) -> DataFrame:
    return with_lower_name(spark.read.parquet(path).select(*CATALOG))


# -- files and contents of the index


def diff_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (path, size, modified) with ``action``: insert, update or skip (the time differs by less than a millisecond)."""
    old = files.select("path", F.col("modified").alias("__old"), F.lit(True).alias("__known"))
    same = F.abs(F.col("modified") - F.col("__old")) < SAME_TIME
    action = F.when(F.col("__known").isNull(), "insert").when(same, "skip").otherwise("update")
    return incoming.join(old, "path", "left").withColumn("action", action).drop("__old", "__known")


def upsert_files(files: DataFrame, incoming: DataFrame, sep: str = "/") -> DataFrame:
    """files (id, path, name, extension, size, modified, has_content, file_ref) after the diff; a new file's id hashes its path.

    One outer join on the path; null in an incoming file_ref keeps the old one.  Of incoming rows with one path the latest
    counts, then the largest.  Two paths whose 64-bit hashes agree would share an id: about n^2 / 2^65 for n files.
    """
    new = _latest(incoming, ["path"], F.struct("modified", "size"))
    has_ref = "file_ref" in incoming.columns
    new = new.select(F.col("path").alias("n_path"), F.col("size").alias("n_size"), F.col("modified").alias("n_modified"), (F.col("file_ref") if has_ref else F.lit(None)).cast("long").alias("n_ref"))
    rows = files.join(new, F.col("path") == F.col("n_path"), "full_outer")
    isnew = F.col("path").isNull()
    newer = F.col("n_path").isNotNull() & (isnew | (F.abs(F.col("modified") - F.col("n_modified")) >= SAME_TIME))
    name = basename(F.col("n_path"), sep)
    pick = lambda value, column: F.when(newer, value).otherwise(F.col(column)).alias(column)
    return rows.select(
        F.coalesce("id", F.xxhash64("n_path")).alias("id"), F.coalesce("path", "n_path").alias("path"),
        pick(name, "name"), pick(extension(name), "extension"), pick(F.col("n_size"), "size"), pick(F.col("n_modified"), "modified"),
        F.coalesce("has_content", F.lit(False)).alias("has_content"), F.coalesce("n_ref", "file_ref").alias("file_ref"),
    )


def upsert_contents(files: DataFrame, contents: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, contents) after new texts (file_id, content) replaced the old ones.

    A null text is a failed extraction: the old text goes and ``has_content`` is cleared, so that the file is tried again.
    """
    clean = F.make_valid_utf8(F.col("content")).alias("content")
    tried = extracted.select("file_id", clean, F.col("content").isNotNull().alias("__ok"))
    tried = _latest(tried, ["file_id"], F.struct("__ok", F.xxhash64("content")))  # of several texts of a file the same one every time
    kept = contents.join(tried, "file_id", "left_anti").select("file_id", "content")
    out = files.join(tried.select(F.col("file_id").alias("id"), "__ok"), "id", "left").withColumn("has_content", F.coalesce("__ok", "has_content")).drop("__ok")
    return out.select(*files.columns), kept.unionByName(tried.where("__ok").select("file_id", "content"))


def needs_reindex(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming rows that are new, have no content yet, or whose time differs."""
    old = files.select("path", F.col("modified").alias("__old"), F.col("has_content").alias("__has"))
    stale = F.col("__old").isNull() | ~F.coalesce("__has", F.lit(False)) | (F.abs(F.col("modified") - F.col("__old")) >= SAME_TIME)
    return incoming.join(old, "path", "left").where(stale).drop("__old", "__has")


def reindex_changed(files: DataFrame, contents: DataFrame, listing: DataFrame, texts_of: Callable[[DataFrame], DataFrame], is_excluded: Callable[[Column], Column] | None = None, sep: str = "/", progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, contents) after the listing's files (path, size, modified) that need it were read again.

    One job: files that are excluded, of no text format, empty or too large are left out; those that are new, have no
    content or another time are passed to ``texts_of``, which adds ``text`` (null: failed); the rest is never opened.  The texts
    are written once, and both tables are made of them; ``progress`` counts what that job sees.
    """
    name = basename(F.col("path"), sep)
    seen = listing if progress is None else progress.listed(listing)
    wanted = seen.where(extractable(extension(name), F.col("size")))
    if is_excluded is not None:
        wanted = wanted.where(~F.coalesce(is_excluded(F.col("path")), F.lit(False)))
    texts = texts_of(needs_reindex(files, wanted)).select(*listing.columns, "text")
    read = staged(texts if progress is None else progress.read(texts), "texts")
    known = upsert_files(files, read.select(*listing.columns), sep)
    ids = known.select("path", F.col("id").alias("file_id"))
    return upsert_contents(known, contents, read.select("path", F.col("text").alias("content")).join(ids, "path").select("file_id", "content"))


def content_by_path(files: DataFrame, contents: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).join(contents, F.col("id") == F.col("file_id")).select("content")


def stats(files: DataFrame, contents: DataFrame) -> DataFrame:
    """n_files and n_contents, in one row."""
    return files.agg(F.count("*").alias("n_files")).crossJoin(contents.agg(F.count("*").alias("n_contents")))


# -- folders


def add_folder(folders: DataFrame, path: str, sep: str = "/") -> DataFrame:
    """folders with one more, its path normalised, unless it is there in any case."""
    row = folders.sparkSession.createDataFrame([(path, None)], "path string, indexed_at double").withColumn("path", normalized(F.col("path"), sep))
    known = folders.select(F.lower(normalized(F.col("path"), sep)).alias("__known"))
    return folders.select("path", "indexed_at").unionByName(row.join(known, F.lower("path") == F.col("__known"), "left_anti"))


def remove_folder(files: DataFrame, contents: DataFrame, folders: DataFrame, path: str, sep: str = "/") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, contents, folders) without the folder, the files below it and their texts."""
    gone = files.where(under(F.col("path"), path, sep))
    kept = files.where(~under(F.col("path"), path, sep))
    return kept, contents.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti"), folders.where(F.col("path") != path)


def stamp_folder(folders: DataFrame, path: str, at: float) -> DataFrame:
    return folders.withColumn("indexed_at", F.when(F.col("path") == path, F.lit(at)).otherwise(F.col("indexed_at")))


def folder_status(folders: DataFrame, pending: DataFrame, indexing: list[str] = ()) -> DataFrame:
    """folders with ``status``: indexing (a job runs over it now), pending, changed (with n_pending) or done.  pending: path, n_pending."""
    rows = folders.join(pending, "path", "left").withColumn("n_pending", F.coalesce("n_pending", F.lit(0)).cast("long"))
    status = F.when(F.col("indexed_at").isNull(), "pending").when(F.col("n_pending") > 0, "changed").otherwise("done")
    return rows.withColumn("status", F.when(F.col("path").isin(*indexing), "indexing").otherwise(status) if indexing else status)


def folder_list(folders: DataFrame) -> DataFrame:
    """The registered folders in the order in which they are listed: by path, capitals first."""
    return folders.orderBy("path")


def needs_scan(catalog: DataFrame, least: int = 1000) -> bool:
    """Whether a start must list all files first, as the stored catalog holds next to nothing; no more rows than needed are counted."""
    return len(catalog.select("path").take(least)) < least


def nested_folders(folders: DataFrame, sep: str = "/") -> DataFrame:
    """outer and inner of every registered folder that lies below another."""
    inner = folders.select(F.col("path").alias("inner"))
    return join_folders(inner, "inner", folders.select(F.col("path").alias("outer")), "outer", sep, with_self=False)


