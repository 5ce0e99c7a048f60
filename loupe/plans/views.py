"""The engine's tables derived from the driver's test tables, in Spark and (for the oracles) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension

EXTENSIONS = (".txt", ".md", ".py", ".pdf", ".exe", "")
FOLDERS = [("C:/en", 1.7e9), ("C:/fr", None), ("C:/en/src1", 1.7e9), ("C:/de", 1.7e9)]
EXCLUDED_PATHS, EXCLUDED_DIRS = ["c:/es"], ["src3", "src7"]
SNAPSHOT_OFFSETS = [("C", 1, 100), ("D", 1, 9000), ("E", 2, 10)]
CURRENT_OFFSETS = [("C", 1, 5000), ("D", 1, 9000), ("E", 3, 500)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    named = d.select("doc_id", "lang", "source", "n_chars", F.concat(F.lit("doc_"), F.col("doc_id"), ext).alias("name"))
    return named.select(
        F.col("doc_id").alias("id"), F.concat_ws("/", F.lit("C:"), "lang", "source", "name").alias("path"), "name", extension(F.col("name")).alias("extension"),
        F.col("n_chars").alias("size"), (F.lit(1.7e9) + F.col("doc_id") * 60.5).alias("modified"), (F.col("doc_id") % 3 != 0).alias("has_content"), F.col("doc_id").alias("file_ref"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select(F.lit("C").alias("drive"), "file_ref", "path", "name", "extension", "size", "modified", F.lit(False).alias("is_dir"), F.lower("name").alias("name_lower"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ten-ary tree over document ids, with orphans and nodes that are their own parents."""
    ref = F.col("doc_id") + 1
    parent = F.when(ref % 97 == 0, ref).when(ref % 89 == 0, -1).otherwise(F.floor(ref / 10)).cast("long")
    return table(spark, sf_dir, "documents").select(F.lit("C").alias("drive"), ref.alias("file_ref"), parent.alias("parent_ref"), F.concat(F.lit("n"), ref).alias("name"), (ref % 7 == 0).alias("is_dir"), F.col("n_chars").alias("size"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    reason = F.when(kind == "click", 1).when(kind == "signup", 0x100).when(kind == "error", 0x200).when(kind == "view", 0x1000).otherwise(0x2000)
    drive = F.when(F.col("user_id") % 2 == 0, "C").otherwise("D")
    return table(spark, sf_dir, "events").select(drive.alias("drive"), F.lit(1).cast("long").alias("journal_id"), F.col("event_id").alias("usn"), F.col("user_id").alias("file_ref"), reason.cast("int").alias("reason"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a later listing has them: unchanged, touched a second later, or under a new name; one touched within the tolerance."""
    k = F.col("id") % 3
    path = F.when(k == 2, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    modified = F.when(F.col("id") == 6, F.col("modified") + 0.0005).when(k == 1, F.col("modified") + 1).otherwise(F.col("modified"))
    return files(spark, sf_dir).select(path.alias("path"), "size", modified.alias("modified"))


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files with a change are now: at a path of their own ref on C, in the folder of another on D."""
    u = change_log(spark, sf_dir).select("drive", "file_ref").distinct()
    name = F.concat(F.lit("f"), (F.col("file_ref") % 50), F.lit(".txt"))
    path = F.concat_ws("/", F.concat("drive", F.lit(":")), F.concat(F.lit("src"), F.col("file_ref") % 11), name)
    return u.select("drive", "file_ref", path.alias("path"), name.alias("name"), (F.col("file_ref") * 3).alias("size"), F.lit(1.7e9).alias("modified"), F.lit(False).alias("is_dir"))


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDERS, "path string, indexed_at double")


def offsets(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "drive string, journal_id long, next_usn long")


# -- the same in DuckDB SQL, as common table expressions

FILES_SQL = """files AS (
  SELECT doc_id AS id, 'C:/' || lang || '/' || source || '/' || name AS path, name, ext AS extension, n_chars AS size,
    1.7e9::DOUBLE + doc_id * 60.5::DOUBLE AS modified, doc_id % 3 <> 0 AS has_content, doc_id AS file_ref
  FROM (SELECT *, 'doc_' || doc_id || ext AS name
    FROM (SELECT *, ['.txt', '.md', '.py', '.pdf', '.exe', ''][(doc_id % 6 + 1)::INT] AS ext FROM documents)))"""
TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
CONTENT_SQL = f"toks AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)"
ENTRIES_SQL = """entries AS (
  SELECT ref AS file_ref, CASE WHEN ref % 97 = 0 THEN ref WHEN ref % 89 = 0 THEN -1 ELSE ref // 10 END AS parent_ref, 'n' || ref AS name
  FROM (SELECT doc_id + 1 AS ref FROM documents))"""
CHANGES_SQL = """changes AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'D' END AS drive, event_id AS usn, user_id AS file_ref,
    CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 256 WHEN 'error' THEN 512 WHEN 'view' THEN 4096 ELSE 8192 END AS reason FROM events),
last AS (
  SELECT drive, file_ref, max(usn) AS usn, arg_max(reason, usn) AS reason FROM changes GROUP BY drive, file_ref)"""
INCOMING_SQL = """incoming AS (
  SELECT CASE WHEN id % 3 = 2 THEN path || '.new' ELSE path END AS path, size,
    CASE WHEN id = 6 THEN modified + 0.0005 WHEN id % 3 = 1 THEN modified + 1 ELSE modified END AS modified FROM files)"""
PRESENT_SQL = """present AS (
  SELECT drive, file_ref, drive || ':/src' || file_ref % 11 || '/f' || file_ref % 50 || '.txt' AS path, 'f' || file_ref % 50 || '.txt' AS name,
    file_ref * 3 AS size FROM last)"""
FOLDERS_SQL = """folders(path, indexed_at) AS (VALUES ('C:/en', 1.7e9::DOUBLE), ('C:/fr', NULL), ('C:/en/src1', 1.7e9::DOUBLE), ('C:/de', 1.7e9::DOUBLE))"""
EXCLUDED_SQL = """(lower({0}) = 'c:/es' OR starts_with(lower({0}), 'c:/es/') OR starts_with(regexp_extract({0}, '[^/]*$'), '~$')
  OR len(list_filter(string_split({0}, '/'), lambda p: p IN ('src3', 'src7') OR starts_with(p, '.') OR starts_with(p, '$'))) > 0)"""
