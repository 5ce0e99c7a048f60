"""Folders walked level by level, and only wanted files opened.

A level's folders are rows, dealt over tasks that list them; conditions on what was found are Columns.  An excluded folder
leaves before the next level, so nothing below it is listed.  Levels are written to one table, which is the listing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import MAX_CONTENT_BYTES, basename, extension
from ..operators.staging import shared_folder
from .files import extract_text

_ENTRY = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("modified", pa.float64())])
#: Folders that one task lists, and bytes that one task opens.
_FOLDERS, _BYTES = 64, 128 << 20


def _plain(path: str) -> str:
    """A local path without its scheme; other addresses as they are."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """What a folder holds; links to folders are left out, so that no walk runs in a circle.  A folder that can't be read holds nothing."""
    try:
        if "://" in folder:
            store, path = fs.FileSystem.from_uri(folder)
            head = folder.removesuffix(path)
            for info in store.get_file_info(fs.FileSelector(path)):
                yield head + info.path, info.type == fs.FileType.Directory, info.size or 0, info.mtime_ns / 1e9 if info.mtime_ns else 0.0
            return
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, True, 0, 0.0
                elif entry.is_file():
                    stat = entry.stat()
                    yield entry.path, False, stat.st_size, stat.st_mtime_ns // 1000 / 1e6
    except OSError:
        return


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            columns = list(zip(*_entries(folder), strict=True)) or [[]] * len(_ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY)


def walk(spark: SparkSession, root: str, is_excluded: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, name, extension, size and modified of the files below root; neither they nor a folder above them is excluded."""

    def kept(rows: DataFrame) -> DataFrame:
        return rows if is_excluded is None else rows.where(~F.coalesce(is_excluded(F.col("path")), F.lit(False)))

    table = f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    folders, n, level = kept(spark.createDataFrame([(_plain(root),)], "path string")), 1, 0
    while n:
        at = f"{table}/level={level}"
        found = folders.repartition(-(-n // _FOLDERS)).mapInArrow(_list, "path string, is_dir boolean, size long, modified double")
        kept(found).write.parquet(at)
        folders = spark.read.schema("path string, is_dir boolean").parquet(at).where("is_dir").select("path")
        n, level = folders.count(), level + 1
    found = spark.read.schema("path string, is_dir boolean, size long, modified double").parquet(table).where("NOT is_dir")
    name = basename(F.col("path"))
    return found.select("path", name.alias("name"), extension(name).alias("extension"), "size", "modified")


def _content(path: str) -> bytes | None:
    try:
        if "://" in path:
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_stream(inner) as data:
                return data.read(MAX_CONTENT_BYTES)
        with open(path, "rb") as data:
            return data.read(MAX_CONTENT_BYTES)
    except OSError:
        return None


def read_texts(files: DataFrame, extension_col: str = "extension") -> DataFrame:
    """files (path, size, ...) with ``text``: each is opened once, in the task that extracts it; null where that fails."""
    total = files.agg(F.sum("size")).first()[0] or 0
    rows = files.select(F.struct(*files.columns).alias("row"), "path", F.col(extension_col).alias("ext"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, ext) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([extract_text(_content(path), ext)], pa.string())], names=["row", "text"])

    dealt = rows.repartition(max(files.sparkSession.sparkContext.defaultParallelism, total // _BYTES + 1))
    return dealt.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")
