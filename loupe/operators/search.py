"""Searching: names in the catalog, and names and contents in the full-text index.

Corpus statistics come from the whole index, before any folder scope: one aggregation
to a single row (combined on the map side), joined back as a broadcast of that row.
Predicates are Columns, so scans read only the columns a query needs.
"""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import in_folders
from ..functions.text import n_tokens, token_text
from . import postings as books
from .index import Index
from .match import Query, idf_of, plain, term_rank

UNLIMITED = 10_000_000


def name_matches(query: str, name_lower: Column) -> Column:
    """All space-separated parts match: a part with * or ? matches the whole name, another one any part of it; no parts match all."""
    tests = []
    for part in query.split():
        if "*" in part or "?" in part:
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in part.lower())
            tests.append(name_lower.rlike(f"(?s)^{pattern}$"))
        else:
            tests.append(F.contains(name_lower, F.lit(part.lower())))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def with_tokens(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with ``<column>_tokens`` for each column and ``n_tokens``; write it once as the index and search that."""
    out = docs.withColumns({f"{c}_tokens": token_text(F.col(c)) for c in columns})
    return out.withColumn("n_tokens", reduce(lambda a, b: a + b, [n_tokens(F.col(f"{c}_tokens")) for c in columns]))


def score(indexed: DataFrame, columns: list[str], query: Query) -> DataFrame:
    """Matching rows with ``rank``: negative BM25, smaller is better."""
    toks = {c: F.col(f"{c}_tokens") for c in columns}
    leaves = query.scored()
    counted = indexed.withColumns({f"__hits{k}": leaf.hits(toks) for k, leaf in enumerate(leaves)} | {"__match": query.matches(toks)})
    holds = [F.sum(leaf.matches(toks).cast("long")).alias(f"__n{k}") for k, leaf in enumerate(leaves)]
    stats = indexed.agg(F.count("*").alias("__all"), F.sum("n_tokens").alias("__tokens"), *holds)
    rows = counted.where("__match").crossJoin(F.broadcast(stats))  # stats is one row
    average = F.col("__tokens") / F.col("__all")
    rank = F.lit(0.0)
    for k in range(len(leaves)):
        idf = idf_of(F.col("__all"), F.coalesce(F.col(f"__n{k}"), F.lit(0)))
        rank = rank - term_rank(idf, F.col(f"__hits{k}").cast("double"), F.col("n_tokens"), average)
    return rows.withColumn("rank", rank).drop("__match", "__all", "__tokens", *(f"__{x}{k}" for k in range(len(leaves)) for x in ("hits", "n")))


def _as_query(query: str | Query | None) -> Query | None:
    return plain(query) if isinstance(query, str) else query


def index_files(files: DataFrame) -> DataFrame:
    """files with tokens of name and path."""
    return with_tokens(files, ["name", "path"])


def index_contents(contents: DataFrame) -> DataFrame:
    """file_contents (file_id, content) with tokens of content."""
    return with_tokens(contents, ["content"])


@dataclasses.dataclass
class StoredFiles:
    """Files with a stored index of their names and paths; it takes the place of ``index_files``' table in a search."""

    files: DataFrame
    index: Index

    def score(self, query: Query) -> DataFrame:
        return self.index.search(query).join(self.files, F.col("doc_id") == F.col("id")).select(*self.files.columns, "rank")


def search_names(indexed_files: DataFrame | StoredFiles, query: str | Query, folders: list[str] | None = None, limit: int = UNLIMITED, sep: str = "/") -> DataFrame:
    """Files whose name or path matches, best rank first."""
    asked = _as_query(query)
    stored = isinstance(indexed_files, StoredFiles)
    if asked is None:
        return (indexed_files.files if stored else indexed_files).limit(0).withColumn("rank", F.lit(0.0))
    scored = indexed_files.score(asked) if stored else score(indexed_files, ["name", "path"], asked)
    found = scored.where(in_folders(F.col("path"), folders or [], sep))
    return found.orderBy("rank", "id").limit(limit) if limit < UNLIMITED else found


def search_contents(indexed_contents: DataFrame | Index, files: DataFrame, query: str | Query, folders: list[str] | None = None, limit: int = UNLIMITED, sep: str = "/") -> DataFrame:
    """Files whose content matches, best rank first."""
    asked = _as_query(query)
    columns = [f"files.{c}" for c in files.columns]
    if asked is None:
        return files.limit(0).withColumn("rank", F.lit(0.0))
    if isinstance(indexed_contents, Index):
        hits = indexed_contents.search(asked).select(F.col("doc_id").alias("file_id"), "rank")
    else:
        hits = score(indexed_contents, ["content"], asked).select("file_id", "rank")
    found = hits.join(files.alias("files"), F.col("file_id") == F.col("files.id")).select(*columns, "rank").where(in_folders(F.col("path"), folders or [], sep))
    return found.orderBy("rank", "id").limit(limit) if limit < UNLIMITED else found


def search_postings(book: DataFrame, doc_lengths: DataFrame, files: DataFrame, query: str | Query, folders: list[str] | None = None, limit: int = UNLIMITED, sep: str = "/") -> DataFrame:
    """``search_contents`` from stored postings: reads the rows of the query's tokens instead of every document."""
    asked = _as_query(query)
    if asked is None:
        return files.limit(0).withColumn("rank", F.lit(0.0))
    columns = [f"files.{c}" for c in files.columns]
    hits = books.score(book, doc_lengths, asked)
    found = hits.join(files.alias("files"), F.col("doc_id") == F.col("files.id")).select(*columns, "rank").where(in_folders(F.col("path"), folders or [], sep))
    return found.orderBy("rank", "id").limit(limit) if limit < UNLIMITED else found


_RESULT = ["file_id", "path", "name", "extension", "size", "modified", "is_dir"]


def _result(rows: DataFrame, file_id: str, is_dir: Column) -> DataFrame:
    return rows.select(
        F.col(file_id).alias("file_id"), "path", "name", F.coalesce("extension", F.lit("")).alias("extension"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("modified", F.lit(0.0)).alias("modified"), is_dir.alias("is_dir"), "rank",
    )


def merge(names: DataFrame, contents: DataFrame) -> DataFrame:
    """Name hits and content hits as one row a path, with match_type filename, content or both."""
    sides = names.withColumn("__side", F.lit(1)).unionByName(contents.withColumn("__side", F.lit(2)))
    picked = F.min_by(F.struct(*_RESULT, "rank"), "__side")
    merged = sides.groupBy(F.col("path").alias("__path")).agg(picked.alias("r"), F.bit_or("__side").alias("sides"))
    kind = F.when(F.col("sides") == 3, "both").when(F.col("sides") == 1, "filename").otherwise("content")
    return merged.select("r.*", kind.alias("match_type"))


def ordered(results: DataFrame) -> DataFrame:
    """both before filename before content, folders first, then by name; ties by rank of the name hit, then of the content hit."""
    priority = F.when(F.col("match_type") == "both", 0).when(F.col("match_type") == "filename", 1).when(F.col("match_type") == "content", 2).otherwise(9)
    return results.orderBy(priority, F.desc("is_dir"), F.lower("name"), F.when(F.col("match_type") == "content", 1).otherwise(0), "rank", "file_id")


def search_catalog(catalog: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Catalog rows (file_ref, path, name, ..., is_dir, name_lower) by name only; 0 is unlimited."""
    rows = catalog.where(name_matches(query, F.col("name_lower"))).withColumn("rank", F.lit(0.0))
    found = ordered(_result(rows, "file_ref", F.coalesce("is_dir", F.lit(False))).withColumn("match_type", F.lit("filename")))
    return found.limit(limit) if limit else found


def search(indexed_files: DataFrame | StoredFiles, indexed_contents: DataFrame | Index, *, names: str | Query = "", contents: str | Query = "", folders: list[str] | None = None, limit: int = 0, branch_limit: int = UNLIMITED, sep: str = "/") -> DataFrame:
    """Index search, over token strings or stored postings.  With both queries only files that match both remain.

    ``limit`` is applied to the merged result; ``branch_limit`` cuts each side by rank before the merge.
    """
    plain_files = (indexed_files.files if isinstance(indexed_files, StoredFiles) else indexed_files).select("id", "path", "name", "extension", "size", "modified")
    name_hits = _result(search_names(indexed_files, names, folders, branch_limit, sep) if names else plain_files.limit(0).withColumn("rank", F.lit(0.0)), "id", F.lit(False))
    content_hits = _result(search_contents(indexed_contents, plain_files, contents, folders, branch_limit, sep) if contents else plain_files.limit(0).withColumn("rank", F.lit(0.0)), "id", F.lit(False))
    found = merge(name_hits, content_hits)
    if names and contents:
        found = found.where(F.col("match_type") == "both")
    found = ordered(found)
    return found.limit(limit) if limit else found


_SORT_KEYS = {"name": "lower(name)", "folder": "lower(regexp_replace(path, '[^/\\\\\\\\]*$', ''))", "size": "size", "modified": "modified", "extension": "lower(extension)", "match_type": "match_type"}


def sort_results(results: DataFrame, key: str = "name", *, descending: bool = False, folders_last_when_descending: bool = False) -> DataFrame:
    """Sorted by one column, folders first; ties by name and id."""
    column = F.expr(_SORT_KEYS.get(key, _SORT_KEYS["name"]))
    folder_order = F.asc("is_dir") if descending and folders_last_when_descending else F.desc("is_dir")
    return results.orderBy(folder_order, column.desc() if descending else column.asc(), F.lower("name"), "file_id")


def page(results: DataFrame, offset: int, n: int) -> DataFrame:
    """Rows offset, ..., offset + n - 1 of an ordered result."""
    return results.offset(offset).limit(n)
