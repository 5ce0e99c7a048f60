"""Path expressions: Columns in, Columns out, no UDF.  ``sep`` is the paths' separator."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Directory names excluded by default, and those only offered.
EXCLUDED_DIRS = ("node_modules", "__pycache__", "$Recycle.Bin", "System Volume Information", "venv", "AppData", "ProgramData")
OPTIONAL_EXCLUDED_DIRS = ("dist", "build", "target", "vendor", "tmp", "temp", "__MACOSX", "coverage")
# Paths excluded by default.
EXCLUDED_PATHS = ("C:\\Windows", "C:\\$Recycle.Bin", "C:\\System Volume Information", "C:\\ProgramData", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\Users\\Default")
#: Excluded by default below a user's own folder.
_PROFILE_DIR = "AppData"
# Extensions whose text is extracted.
TEXT_EXTENSIONS = (
    ".txt", ".md", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".cs", ".html", ".css", ".xml", ".json", ".yaml", ".yml", ".toml",
    ".ini", ".cfg", ".conf", ".log", ".csv", ".bat", ".ps1", ".sh", ".sql", ".r", ".go", ".rs", ".kt", ".swift", ".rb", ".php",
)
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".pptx", ".hwpx", ".hwp")
MAX_CONTENT_BYTES = 200 * 1024 * 1024


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def basename(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, re.escape(sep)), -1)


def dirname(path: Column, sep: str = "/") -> Column:
    e = re.escape(sep)
    return F.when(F.contains(path, F.lit(sep)), F.regexp_replace(path, f"{e}[^{e}]*$", "")).otherwise(F.lit(""))


def extension(name: Column) -> Column:
    """Lower-cased, with its dot; leading dots begin no extension."""
    return F.regexp_extract(F.lower(name), r"^.*[^.].*?(\.[^.]*)$", 1)


def drive(path: Column) -> Column:
    return F.when(F.substring(path, 2, 1) == ":", F.upper(F.substring(path, 1, 1))).otherwise("?")


def without_long_prefix(path: Column) -> Column:
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def normalized(path: Column, sep: str = "/") -> Column:
    """Both kinds of slash become ``sep``; empty, '.' and '..' components are resolved."""
    parts = F.split(F.translate(path, "/\\", sep * 2), re.escape(sep))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    kept = F.aggregate(
        F.when(F.size(parts) > 1, rest).otherwise(F.array().cast("array<string>")),
        F.slice(parts, 1, 1),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, sep)


def under(path: Column, folder: str | Column, sep: str = "/", *, or_equal: bool = False) -> Column:
    """Whether path lies below folder; ASCII letters compare without case."""
    low = ascii_lower(path)
    top = F.rtrim(ascii_lower(folder if isinstance(folder, Column) else F.lit(folder)), F.lit(sep))
    below = F.startswith(low, F.concat(top, F.lit(sep)))
    return below | (low == top) if or_equal else below


def in_folders(path: Column, folders: Iterable[str], sep: str = "/") -> Column:
    """Whether path lies below one of the folders; no folders: no restriction."""
    tests = [under(path, f, sep) for f in folders]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return out


def default_excluded_paths(profile: str = "") -> list[str]:
    """Paths excluded by default, with that below a user's folder (such as ``C:\\Users\\me``)."""
    return [*EXCLUDED_PATHS, f"{profile}\\{_PROFILE_DIR}".lstrip("\\")]


def comparable(path: Column) -> Column:
    """Lower case with single slashes and without '.' and '..', so that spellings of one path are equal."""
    plain = F.rtrim(F.translate(F.lower(path), "\\", "/"), F.lit("/"))
    return F.when(F.rlike(plain, F.lit(r"//|/\.\.?(/|$)")), normalized(plain)).otherwise(plain)


def excluded(path: Column, paths: Iterable[str] = (), dirs: Iterable[str] = ()) -> Column:
    """The exclusion rule: office lock files, excluded paths and what is below them (any case, either slash), and paths with a
    component that is an excluded name (exact case) or starts with a dot or a dollar sign."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    named = list(dirs)
    part = lambda p: F.startswith(p, F.lit(".")) | F.startswith(p, F.lit("$")) | (p.isin(*named) if named else F.lit(False))
    out = F.startswith(F.element_at(parts, -1), F.lit("~$")) | F.exists(parts, part)
    low = comparable(path)
    for top in paths:
        clean = "/".join(x for x in top.lower().replace("\\", "/").split("/") if x not in ("", "."))
        out = out | (low == clean) | F.startswith(low, F.lit(f"{clean}/"))
    return out


def ancestors(path: Column, sep: str = "/", *, with_self: bool = True) -> Column:
    """ASCII-lower-cased folders that path lies below (and itself): the keys that turn a prefix join into an equi-join."""
    parts = F.split(ascii_lower(path), re.escape(sep))
    last = F.size(parts) if with_self else F.size(parts) - 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))).otherwise(F.array().cast("array<string>"))


def join_folders(rows: DataFrame, path_col: str, folders: DataFrame, folder_col: str, sep: str = "/", *, with_self: bool = True, how: str = "inner") -> DataFrame:
    """rows ⋈ folders where the row's path is below (or is) the folder.

    A hash join on exploded ancestors: linear in the paths' depth, where a prefix condition would compare all pairs.
    ``how``: inner keeps one row for each pair, left_semi and left_anti keep rows once.
    """
    keys = folders.withColumn("__key", F.rtrim(ascii_lower(F.col(folder_col)), F.lit(sep)))
    if how == "inner":
        return rows.withColumn("__key", F.explode(ancestors(F.col(path_col), sep, with_self=with_self))).join(keys, "__key").drop("__key")
    exploded = rows.select(path_col, F.explode(ancestors(F.col(path_col), sep, with_self=with_self)).alias("__key"))
    hit = exploded.join(keys.select("__key"), "__key", "left_semi").select(F.col(path_col).alias("__hit")).distinct()
    return rows.join(hit, F.col(path_col) == F.col("__hit"), how)


def extractable(extension_col: Column, size: Column) -> Column:
    return extension_col.isin(*TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS) & (size > 0) & (size <= MAX_CONTENT_BYTES)
