"""Exclusion settings and journal offsets: small tables that are read, merged and written whole."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXCLUDED_DIRS, EXCLUDED_PATHS, normalized

_SCHEMA = "excluded_paths array<string>, excluded_dirs array<string>"


def load(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The settings in a JSON file; a missing or unreadable file or key gives the defaults."""
    try:
        row = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).first()
    except AnalysisException:
        row = None
    found = row.asDict() if row else {}
    return {"excluded_paths": found.get("excluded_paths") or list(EXCLUDED_PATHS), "excluded_dirs": found.get("excluded_dirs") or sorted(EXCLUDED_DIRS)}


def save(spark: SparkSession, path: str, **changes: list[str]) -> None:
    """Writes the settings with some of them changed; names of directories are sorted."""
    now = load(spark, path) | changes
    row = (now["excluded_paths"], sorted(now["excluded_dirs"]))
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def add_path(paths: list[str], new: str) -> list[str]:
    """The list with a path that isn't in it yet, however its case and slashes are written."""
    clean = lambda p: "/".join(x for x in p.replace("\\", "/").rstrip("/").lower().split("/") if x != ".")
    return paths if clean(new) in map(clean, paths) else [*paths, new]


def distinct_paths(paths: DataFrame, path_col: str = "path", sep: str = "/") -> DataFrame:
    """One row a path without regard to case and slashes, the first spelling in order."""
    return paths.groupBy(F.lower(normalized(F.col(path_col), sep)).alias("__key")).agg(F.min(path_col).alias(path_col)).select(path_col)


def upsert_offsets(offsets: DataFrame, new: DataFrame) -> DataFrame:
    """drive (upper case), journal_id and next_usn with the new rows in place of the old."""
    rows = lambda df, order: df.select(F.upper("drive").alias("drive"), "journal_id", "next_usn", F.lit(order).alias("o"))
    last = rows(offsets, 0).unionByName(rows(new, 1)).groupBy("drive").agg(F.max_by(F.struct("journal_id", "next_usn"), F.struct("o", "next_usn")).alias("r"))
    return last.select("drive", "r.journal_id", "r.next_usn")


def offset_of(offsets: DataFrame, drive: str) -> tuple[int, int] | None:
    row = offsets.where(F.upper("drive") == drive.upper()).select("journal_id", "next_usn").first()
    return tuple(row) if row else None
