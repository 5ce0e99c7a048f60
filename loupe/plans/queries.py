"""One query an operator over the driver's tables, each with its oracle where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, present, text
from ..operators import catalog, index, match, names, postings, progress, search, settings, tree
from ..operators.staging import shared_folder, staged
from ..sources import files as sources
from ..sources import folders, records
from ..streaming import changes
from . import samples, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


F_, T_, C_ = views.FILES_SQL, views.CONTENT_SQL, views.CHANGES_SQL


# -- names and paths

_NAMES: dict[tuple[str, str], names.NameIndex] = {}


def _names(spark: SparkSession, sf: str) -> names.NameIndex:
    """The stored names of ``files``, built once a Spark application and folder of tables."""
    key = spark.sparkContext.applicationId, sf
    if key not in _NAMES:
        _NAMES[key] = names.NameIndex(spark, f"{shared_folder(spark)}/names-{uuid.uuid4().hex}")
        _NAMES[key].build(views.files(spark, sf))
    return _NAMES[key]


@query(f"WITH {F_} SELECT id, name FROM files WHERE contains(lower(name), '_1')")
def name_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Two letters only: all names are scanned."""
    return _names(spark, sf).search("_1")


@query(f"WITH {F_} SELECT id, name FROM files WHERE regexp_full_match(lower(name), 'doc_.5.*\\.py')")
def name_glob(spark: SparkSession, sf: str) -> DataFrame:
    """By the pieces doc, oc_ and .py of the stored names."""
    return _names(spark, sf).search("DOC_?5*.py")


@query(f"WITH {F_} SELECT id, name FROM files WHERE contains(lower(name), 'c_17')")
def name_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).search("C_17")


@query(f"WITH {F_} SELECT id, name FROM files WHERE regexp_full_match(lower(name), '.*\\.md') AND contains(lower(name), '7')")
def name_multi_token(spark: SparkSession, sf: str) -> DataFrame:
    return views.files(spark, sf).where(search.name_matches("*.md 7", F.lower("name"))).select("id", "name")


@query(f"WITH {F_} SELECT id, path FROM files WHERE starts_with(lower(path), 'c:/fr/') OR starts_with(lower(path), 'c:/en/src1/')")
def folder_scope(spark: SparkSession, sf: str) -> DataFrame:
    return views.files(spark, sf).where(paths.in_folders(F.col("path"), ["C:/FR", "C:/en/src1"])).select("id", "path")


def _excluded(path: Column) -> Column:
    return paths.excluded(path, views.EXCLUDED_PATHS, views.EXCLUDED_DIRS)


@query(f"WITH {F_} SELECT id, path FROM files WHERE NOT {views.EXCLUDED_SQL.format('path')}")
def exclusion_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.files(spark, sf).where(~_excluded(F.col("path"))).select("id", "path")


@query(f"WITH {F_} SELECT id, path FROM files WHERE NOT starts_with(lower(path), 'c:/es/') AND NOT starts_with(lower(path), 'c:/de/src1/')")
def excluded_paths_anti(spark: SparkSession, sf: str) -> DataFrame:
    """The exclusion list as a table: an anti join on ancestors."""
    tops = spark.createDataFrame([("C:/es",), ("c:/de/SRC1",)], "top string")
    return paths.join_folders(views.files(spark, sf).select("id", "path"), "path", tops, "top", how="left_anti").select("id", "path")


@query(f"WITH {F_} SELECT id, extension FROM files WHERE extension IN ('.txt', '.md', '.py', '.pdf') AND size > 0 AND size <= 209715200")
def extractable_files(spark: SparkSession, sf: str) -> DataFrame:
    return views.files(spark, sf).where(paths.extractable(F.col("extension"), F.col("size"))).select("id", "extension")


@query(f"""WITH {F_} SELECT id, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS dir,
  lower(regexp_extract(name, '^.*[^.].*?(\\.[^.]*)$', 1)) AS ext FROM files""")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return views.files(spark, sf).select("id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(F.col("name")).alias("ext"))


@query("SELECT event_id, CASE WHEN substr(p, 2, 1) = ':' THEN upper(substr(p, 1, 1)) ELSE '?' END AS drive FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'c:/x' WHEN event_id % 3 = 1 THEN 'D:/y' ELSE '/z' END AS p FROM events)")
def drive_of_path(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("event_id") % 3 == 0, "c:/x").when(F.col("event_id") % 3 == 1, "D:/y").otherwise("/z")
    return views.table(spark, sf, "events").select("event_id", paths.drive(p).alias("drive"))


@query("SELECT event_id, 'C:/' || event_type || '/u' || user_id AS path FROM events")
def normalized_paths(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("C:\\x\\..//"), "event_type", F.lit("/./"), F.lit("y/../u"), "user_id")
    return views.table(spark, sf, "events").select("event_id", paths.normalized(raw).alias("path"))


# -- full text


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    return search.index_contents(views.contents(spark, sf))


def _matching(spark: SparkSession, sf: str, asked: match.Query) -> DataFrame:
    toks = {"content": text.token_text(F.col("content"))}
    return views.contents(spark, sf).where(asked.matches(toks)).select("file_id")


@query(f"WITH {T_} SELECT doc_id AS file_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM toks")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = text.tokens(F.col("content"))
    return views.contents(spark, sf).select("file_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {T_} SELECT token, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_hits FROM (SELECT doc_id, unnest(t) AS token FROM toks) GROUP BY token")
def token_doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    words = views.contents(spark, sf).select("file_id", F.explode(text.tokens(F.col("content"))).alias("token"))
    per_doc = words.groupBy("token", "file_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_hits"))


@query(f"WITH {T_} SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avg_tokens, max(len(t))::BIGINT AS max_tokens FROM toks")
def doc_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_tokens")
    return _indexed(spark, sf).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avg_tokens"), F.max(n).cast("long").alias("max_tokens"))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE len(list_filter(t, lambda x: starts_with(x, 'ingo'))) > 0")
def fts_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.prefix("ingo"))


_PAIR = "len(list_filter(range(1, len(t)), lambda i: t[i] = '{}' AND {})) > 0"


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE " + _PAIR.format("of", "t[i + 1] = 'the'"))
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.phrase("of the"))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE " + _PAIR.format("the", "starts_with(t[i + 1], 'in')"))
def fts_phrase_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.phrase("The in", prefix=True))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'est'))) > 0")
def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.word("the") & match.prefix("est"))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE list_contains(t, 'estion') OR (list_contains(t, 'ingor') AND list_contains(t, 'esing'))")
def fts_or(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.word("estion") | (match.word("ingor") & match.word("esing")))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE list_contains(t, 'the') AND NOT list_contains(t, 'of')")
def fts_not(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.word("the") - match.word("of"))


@query(f"""WITH {T_}, p AS (SELECT doc_id, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'with') AS a, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'was') AS b FROM toks),
x AS (SELECT doc_id, unnest(a) AS i, b FROM p), y AS (SELECT doc_id, i, unnest(b) AS j FROM x)
SELECT DISTINCT doc_id AS file_id FROM y WHERE abs(i - j) - 1 <= 4""")
def fts_near(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.near("with", "was", gap=4))


@query(f"WITH {T_} SELECT doc_id AS file_id FROM toks WHERE t[1] = 'the'")
def fts_initial(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, match.first("the"))


@query(f"WITH {F_}, t AS (SELECT id, {views.TOKENS.format('path')} AS t FROM files) SELECT id FROM t WHERE list_contains(t, 'src7')")
def fts_column(spark: SparkSession, sf: str) -> DataFrame:
    f = views.files(spark, sf)
    toks = {c: text.token_text(F.col(c)) for c in ("name", "path")}
    return f.where(match.word("src7").within("path").matches(toks)).select("id")


_BM25 = f"""WITH {T_}, h AS (
  SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS f1, len(list_filter(t, lambda x: starts_with(x, 'est'))) AS f2 FROM toks),
s AS (SELECT count(*) AS docs, avg(n) AS avg_n, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM h),
i AS (
  SELECT avg_n, CASE WHEN x1 <= 0 THEN 1e-6 ELSE x1 END AS i1, CASE WHEN x2 <= 0 THEN 1e-6 ELSE x2 END AS i2
  FROM (SELECT avg_n, ln((docs - n1 + 0.5) / (n1 + 0.5)) AS x1, ln((docs - n2 + 0.5) / (n2 + 0.5)) AS x2 FROM s)),
r AS (
  SELECT doc_id AS file_id, -(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / avg_n)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / avg_n))) AS rank
  FROM h, i WHERE f1 > 0 AND f2 > 0)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return search.score(_indexed(spark, sf), ["content"], match.word("the") & match.prefix("est")).select("file_id", "rank")


@query(_BM25 + " SELECT file_id, round(rank, 6) AS rank FROM r")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).withColumn("rank", F.round("rank", 6))


_INDEXES: dict[tuple[str, str, str], index.Index] = {}


def _stored(spark: SparkSession, sf: str, what: str) -> index.Index:
    """The stored index of ``contents`` or of ``files``, built once a Spark application and folder of tables."""
    key = spark.sparkContext.applicationId, sf, what
    if key not in _INDEXES:
        docs, id_col, columns = (views.contents(spark, sf), "file_id", ["content"]) if what == "contents" else (views.files(spark, sf), "id", ["name", "path"])
        _INDEXES[key] = index.Index(spark, f"{shared_folder(spark)}/index-{what}-{uuid.uuid4().hex}", columns)
        _INDEXES[key].replace(docs.select(id_col, *columns), id_col)
    return _INDEXES[key]


@query(_BM25 + " SELECT file_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, file_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    best, _ = _stored(spark, sf, "contents").top(match.word("the") & match.prefix("est"), 20)
    return best.select(F.col("doc_id").alias("file_id"), F.round("rank", 6).alias("rank"))


@query(f"""WITH {T_}, n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_n FROM toks),
h AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS f1, len(list_filter(t, lambda x: x = 'of')) AS f2 FROM toks),
i AS (SELECT CASE WHEN a <= 0 THEN 1e-6 ELSE a END AS i1, CASE WHEN b <= 0 THEN 1e-6 ELSE b END AS i2 FROM (
  SELECT ln((any_value(n_docs) - count(*) FILTER (f1 > 0) + 0.5) / (count(*) FILTER (f1 > 0) + 0.5)) AS a, ln((any_value(n_docs) - count(*) FILTER (f2 > 0) + 0.5) / (count(*) FILTER (f2 > 0) + 0.5)) AS b FROM h, n))
SELECT doc_id AS file_id, round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / avg_n)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / avg_n))), 6) AS rank
FROM h, i, n WHERE f1 > 0 OR f2 > 0 ORDER BY -(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / avg_n)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / avg_n))), doc_id LIMIT 10""")
def bm25_block_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words: blocks that can't reach the tenth best rank are skipped."""
    best, _ = _stored(spark, sf, "contents").top(match.word("the") | match.word("of"), 10)
    return best.select(F.col("doc_id").alias("file_id"), F.round("rank", 6).alias("rank"))


@query(_BM25 + " SELECT file_id, round(rank, 6) AS rank FROM r")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranks from stored postings, without reading a text."""
    found = _stored(spark, sf, "contents").search(match.word("the") & match.prefix("est"))
    return found.select(F.col("doc_id").alias("file_id"), F.round("rank", 6).alias("rank"))


@query(f"""WITH {T_}, p AS (SELECT doc_id, list_filter(range(len(t)), lambda i: t[i + 1] = 'the') AS a, list_filter(range(len(t)), lambda i: t[i + 1] = 'of') AS b FROM toks)
SELECT doc_id FROM p WHERE len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 3)) > 0)) > 0""")
def near_postings(spark: SparkSession, sf: str) -> DataFrame:
    """NEAR from stored positions: at most two tokens between."""
    return _stored(spark, sf, "contents").search(match.near("the", "of", gap=2)).select("doc_id")


@query(f"WITH {T_} SELECT doc_id, count(*)::BIGINT AS hits FROM (SELECT doc_id, unnest(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS i FROM toks) GROUP BY doc_id")
def postings_phrase(spark: SparkSession, sf: str) -> DataFrame:
    book = postings.build(views.contents(spark, sf), "file_id", ["content"])
    return postings.phrase_documents(book, ["of", "the"])


@query(f"WITH {T_} SELECT doc_id FROM toks WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'ing'))) > 0 AND doc_id % 10 <> 1")
def postings_maintain(spark: SparkSession, sf: str) -> DataFrame:
    """An index whose documents are removed or get their present text in segments of their own, which are then merged."""
    docs = views.contents(spark, sf)
    kept = index.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", ["content"])
    kept.replace(docs.withColumn("content", F.when(F.col("file_id") % 10 == 2, "the ing old").otherwise(F.col("content"))), "file_id")
    kept.remove(docs.where(F.col("file_id") % 10 == 1), "file_id")
    kept.replace(docs.where(F.col("file_id") % 10 == 2), "file_id")
    kept.compact(2)
    return postings.documents_with(kept.postings(), ["the", "ing"], prefix=True)


# -- search


@query(f"WITH {F_}, {T_} SELECT id, path FROM files JOIN toks ON doc_id = id WHERE list_contains(t, 'estion') AND starts_with(lower(path), 'c:/en/')")
def content_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_contents(_stored(spark, sf, "contents"), views.files(spark, sf), match.word("estion"), ["C:/en"]).select("id", "path")


_SIDES = f"""WITH {F_}, {T_}, sides AS (
  SELECT id, path, name, len(list_filter({views.TOKENS.format('name')} || {views.TOKENS.format('path')}, lambda x: starts_with(x, 'src1'))) > 0 AS n,
    len(list_filter(t, lambda x: starts_with(x, 'esti'))) > 0 AS c FROM files JOIN toks ON doc_id = id)"""
_KIND = "CASE WHEN n AND c THEN 'both' WHEN n THEN 'filename' ELSE 'content' END"


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    f = search.index_files(views.files(spark, sf))
    names = search._result(search.search_names(f, "src1"), "id", F.lit(False))
    hits = search._result(search.search_contents(_indexed(spark, sf), views.files(spark, sf), "esti"), "id", F.lit(False))
    return search.merge(names, hits)


@query(f"{_SIDES} SELECT id AS file_id, path, {_KIND} AS match_type FROM sides WHERE n OR c")
def match_type_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("file_id", "path", "match_type")


@query(f"{_SIDES} SELECT id AS file_id, path, 'both' AS match_type FROM sides WHERE n AND c")
def name_and_content(spark: SparkSession, sf: str) -> DataFrame:
    f = search.StoredFiles(views.files(spark, sf), _stored(spark, sf, "files"))
    return search.search(f, _stored(spark, sf, "contents"), names="src1", contents="esti").select("file_id", "path", "match_type")


@query(f"""{_SIDES} SELECT place::INTEGER AS place, file_id, match_type FROM (
  SELECT row_number() OVER (ORDER BY n AND c DESC, n DESC, lower(name), id) AS place, id AS file_id, {_KIND} AS match_type FROM sides WHERE n OR c) WHERE place <= 50""")
def ranked_results(spark: SparkSession, sf: str) -> DataFrame:
    top = search.ordered(_merged(spark, sf)).limit(50)  # a report of 50 rows, numbered on one task
    return _numbered(top).select("place", "file_id", "match_type")


def _numbered(top: DataFrame) -> DataFrame:
    listed = top.agg(F.collect_list(F.struct(*top.columns)).alias("rows"))
    return listed.select(F.posexplode("rows").alias("p", "r")).select((F.col("p") + 1).alias("place"), "r.*")


@query(f"WITH {F_} SELECT id AS file_id, name FROM files WHERE regexp_full_match(lower(name), '.*\\.py')")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_catalog(views.catalog(spark, sf), "*.py").select("file_id", "name")


@query(f"WITH {F_} SELECT row_number() OVER (ORDER BY size DESC, lower(name), id)::INTEGER AS place, id AS file_id, size FROM files QUALIFY place <= 30")
def sort_by_size_desc(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.files(spark, sf).select(F.col("id").alias("file_id"), "name", "path", "extension", "size", "modified", F.lit(False).alias("is_dir"))
    return _numbered(search.page(search.sort_results(rows, "size", descending=True), 0, 30)).select("place", "file_id", "size")


# -- catalog


@query("SELECT count(*)::BIGINT AS n_files, count(*)::BIGINT AS n_contents FROM documents")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stats(views.files(spark, sf), views.contents(spark, sf))


@query(f"""WITH {F_}, {views.INCOMING_SQL} SELECT i.path, CASE WHEN f.path IS NULL THEN 'insert' WHEN abs(i.modified - f.modified) < 0.001 THEN 'skip' ELSE 'update' END AS action
FROM incoming i LEFT JOIN files f ON i.path = f.path""")
def upsert_diff(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.diff_files(views.files(spark, sf), views.incoming(spark, sf)).select("path", "action")


@query(f"""WITH {F_}, {views.INCOMING_SQL} SELECT coalesce(f.path, i.path) AS path, round(CASE WHEN i.path IS NOT NULL AND (f.path IS NULL OR abs(i.modified - f.modified) >= 0.001) THEN i.modified ELSE f.modified END, 3) AS modified,
  coalesce(f.has_content, false) AS has_content, f.file_ref FROM files f FULL JOIN incoming i ON i.path = f.path""")
def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.upsert_files(views.files(spark, sf), views.incoming(spark, sf)).select("path", F.round("modified", 3).alias("modified"), "has_content", "file_ref")


@query("""SELECT doc_id AS file_id, doc_id % 5 <> 0 AS has_content, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 4 ELSE length(text) END::BIGINT AS n_chars FROM documents""")
def upsert_contents(spark: SparkSession, sf: str) -> DataFrame:
    f, c = views.files(spark, sf).withColumn("has_content", F.lit(True)), views.contents(spark, sf)
    new = c.where("file_id % 5 < 2").select("file_id", F.when(F.col("file_id") % 5 == 1, "text").alias("content"))
    f, c = catalog.upsert_contents(f, c, new)
    return f.join(c, f["id"] == c["file_id"], "left").select(f["id"].alias("file_id"), "has_content", F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {F_}, {views.INCOMING_SQL} SELECT i.path FROM incoming i LEFT JOIN files f ON i.path = f.path WHERE f.path IS NULL OR NOT f.has_content OR abs(i.modified - f.modified) >= 0.001""")
def needs_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.needs_reindex(views.files(spark, sf), views.incoming(spark, sf)).select("path")


@query(f"""WITH {F_}, {views.INCOMING_SQL}, stale AS (
  SELECT i.path, i.modified, d.text FROM incoming i JOIN files o ON i.path IN (o.path, o.path || '.new') JOIN documents d ON d.doc_id = o.id LEFT JOIN files f ON i.path = f.path
  WHERE i.size > 0 AND regexp_matches(i.path, '\\.(txt|md|py|pdf)$') AND NOT {views.EXCLUDED_SQL.format('i.path')} AND (f.path IS NULL OR NOT f.has_content OR abs(i.modified - f.modified) >= 0.001))
SELECT coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN f.has_content ELSE NOT ends_with(s.path, '.pdf') END AS has_content,
  CASE WHEN s.path IS NULL THEN length(d.text) WHEN NOT ends_with(s.path, '.pdf') THEN length(s.text) END::BIGINT AS n_chars
FROM files f FULL JOIN stale s ON f.path = s.path LEFT JOIN documents d ON d.doc_id = f.id""")
def reindex_changed(spark: SparkSession, sf: str) -> DataFrame:
    """The reindex job over a later listing: only stale files are opened, and a file without a reader loses its content."""
    f, c = views.files(spark, sf), views.contents(spark, sf)
    of = f.join(c, F.col("id") == F.col("file_id")).select(F.col("path").alias("old"), F.encode("content", "UTF-8").alias("bytes"))

    def texts_of(stale: DataFrame) -> DataFrame:
        found = stale.join(of, F.regexp_replace("path", r"\.new$", "") == F.col("old"))
        return sources.extract(found.withColumn("ext", paths.extension(F.col("path"))), "bytes", "ext")

    f, c = catalog.reindex_changed(f, c, views.incoming(spark, sf), texts_of, _excluded)
    return f.join(c, f["id"] == c["file_id"], "left").select("path", "has_content", F.length("content").cast("long").alias("n_chars"))


@query(f"""WITH {F_}, r AS (SELECT id, path, extension, has_content, coalesce(text, '') AS text FROM files JOIN documents ON doc_id = id)
SELECT substr(path, 3) AS path, has_content OR extension <> '.pdf' AS has_content, CASE WHEN has_content OR extension <> '.pdf' THEN md5(text) END AS text_md5 FROM r
WHERE has_content OR (extension IN ('.txt', '.md', '.py', '.pdf') AND text <> '' AND NOT regexp_matches(path, '/src[37]/'))""")
def index_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of real files, of which the index knows some: it is walked without its excluded subtrees, and only what the index lacks is opened."""
    root = f"{shared_folder(spark).removeprefix('file:').rstrip('/')}/folder-{uuid.uuid4().hex}"
    samples.write_folder(spark, sf, root)
    known = views.files(spark, sf).where("has_content").withColumn("path", samples.in_folder(root, F.col("path")))
    f, c = catalog.reindex_changed(known, views.contents(spark, sf).join(known.select(F.col("id").alias("file_id")), "file_id"), folders.walk(spark, root, _hidden), folders.read_texts, _hidden)
    found = f.join(c, f["id"] == c["file_id"], "left")
    return found.select(F.substring("path", len(root) + 1, 1 << 20).alias("path"), "has_content", F.md5("content").alias("text_md5"))


def _hidden(p: Column) -> Column:
    return paths.excluded(p, (), views.EXCLUDED_DIRS)


@query(f"WITH {F_} SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents JOIN files ON id = doc_id WHERE name = 'doc_12.txt'")
def content_by_path(spark: SparkSession, sf: str) -> DataFrame:
    f = views.files(spark, sf)
    path = f.where(F.col("name") == "doc_12.txt").select("path")
    return f.join(path, "path").join(views.contents(spark, sf), F.col("id") == F.col("file_id")).select(F.col("id").alias("doc_id"), F.length("content").cast("long").alias("n_chars"))


@query("SELECT lang, count(*)::BIGINT AS n_files, count(*)::BIGINT AS n_contents FROM documents WHERE lang <> 'en' GROUP BY lang")
def remove_folder(spark: SparkSession, sf: str) -> DataFrame:
    f, c, _ = catalog.remove_folder(views.files(spark, sf), views.contents(spark, sf), views.folders(spark), "c:/EN")
    rows = f.join(c, f["id"] == c["file_id"], "full_outer").withColumn("lang", F.element_at(F.split("path", "/"), 2))
    return rows.groupBy("lang").agg(F.count("id").alias("n_files"), F.count("file_id").alias("n_contents"))


@query("""WITH folders AS (SELECT DISTINCT unnest(['C:/' || lang, 'C:/' || lang || '/' || source, 'C:/' || lang || '/' || source || '/d' || doc_id % 10]) AS path FROM documents)
SELECT a.path AS outer, b.path AS inner FROM folders a JOIN folders b ON starts_with(lower(b.path), lower(a.path) || '/')""")
def folder_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of three levels, all of which are registered."""
    top = F.concat_ws("/", F.lit("C:"), "lang")
    parts = [top, F.concat_ws("/", top, "source"), F.concat_ws("/", top, "source", F.concat(F.lit("d"), F.col("doc_id") % 10))]
    return catalog.nested_folders(views.table(spark, sf, "documents").select(F.explode(F.array(*parts)).alias("path")).distinct())


_ROUTED = f"WITH {F_}, {views.FOLDERS_SQL}, routed AS (SELECT f.path AS folder, d.path FROM files d JOIN folders f ON starts_with(lower(d.path), lower(f.path) || '/'))"


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Every file counts as changed."""
    return views.files(spark, sf).select("path")


@query(f"""{_ROUTED}, p AS (SELECT folder, count(DISTINCT path) AS n FROM routed GROUP BY folder)
SELECT f.path, coalesce(n, 0)::BIGINT AS n_pending, CASE WHEN indexed_at IS NULL THEN 'pending' WHEN coalesce(n, 0) > 0 THEN 'changed' ELSE 'done' END AS status FROM folders f LEFT JOIN p ON p.folder = f.path""")
def folder_status(spark: SparkSession, sf: str) -> DataFrame:
    pending = changes.pending_by_folder(_changed(spark, sf), views.folders(spark)).withColumnRenamed("folder", "path")
    return catalog.folder_status(views.folders(spark), pending).select("path", "n_pending", "status")


@query(f"""{_ROUTED}, p AS (SELECT folder, count(DISTINCT path) AS n FROM routed GROUP BY folder)
SELECT row_number() OVER (ORDER BY f.path)::INTEGER AS place, f.path, CASE WHEN f.path = 'C:/en' THEN 'indexing' WHEN indexed_at IS NULL THEN 'pending' WHEN coalesce(n, 0) > 0 THEN 'changed' ELSE 'done' END AS status
FROM folders f LEFT JOIN p ON p.folder = f.path""")
def folder_list(spark: SparkSession, sf: str) -> DataFrame:
    """The registered folders as they are listed, one of them being indexed just now; a list of registered folders fits one task."""
    pending = changes.pending_by_folder(_changed(spark, sf), views.folders(spark)).withColumnRenamed("folder", "path")
    status = catalog.folder_status(views.folders(spark), pending, indexing=["C:/en"])
    return _numbered(catalog.folder_list(status).select("path", "status")).select("place", "path", "status")


_TREE = f"""WITH RECURSIVE {views.ENTRIES_SQL}, inner_ AS (SELECT * FROM entries WHERE file_ref <> parent_ref),
r AS (
  SELECT file_ref, 'C:/' || name AS path, 1 AS depth FROM inner_ WHERE parent_ref NOT IN (SELECT file_ref FROM inner_) {{0}}
  UNION ALL SELECT e.file_ref, r.path || '/' || e.name, depth + 1 FROM inner_ e JOIN r ON e.parent_ref = r.file_ref WHERE depth < 256 {{1}})
SELECT file_ref, path FROM r"""


@query(_TREE.format("", ""))
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree.resolve_paths(views.entries(spark, sf), F.concat("drive", F.lit(":/"))).select("file_ref", "path")


@query(_TREE.format("AND NOT regexp_matches(name, '3$')", "AND NOT regexp_matches(e.name, '3$')"))
def resolve_paths_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return tree.resolve_paths(views.entries(spark, sf), F.concat("drive", F.lit(":/")), exclude=lambda p: F.endswith(p, F.lit("3"))).select("file_ref", "path")


_CHAINS = """entries AS (
  SELECT doc_id + 1 AS file_ref, CASE WHEN doc_id = 0 THEN 7 WHEN doc_id = 7 OR doc_id % 400 = 20 THEN -1 ELSE doc_id END AS parent_ref, 'n' || (doc_id + 1) AS name FROM documents)"""


@query(f"""WITH RECURSIVE {_CHAINS}, r AS (
  SELECT file_ref, 'C:/' || name AS path FROM entries WHERE parent_ref = -1 OR file_ref = 1
  UNION ALL SELECT e.file_ref, r.path || '/' || e.name FROM entries e JOIN r ON e.parent_ref = r.file_ref WHERE e.file_ref <> 1)
SELECT file_ref, path FROM r""")
def resolve_paths_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of up to 400 entries, and a cycle of seven that is cut at its smallest reference."""
    doc = F.col("doc_id")
    parent = F.when(doc == 0, 7).when((doc == 7) | (doc % 400 == 20), -1).otherwise(doc)
    entries = views.table(spark, sf, "documents").select(F.lit("C").alias("drive"), (doc + 1).alias("file_ref"), parent.alias("parent_ref"), F.concat(F.lit("n"), doc + 1).alias("name"))
    return tree.resolve_paths(entries, "C:/").select("file_ref", "path")


@query(f"{_TREE.format('', '')} WHERE path NOT LIKE '%/n1%'")
def populate_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Entries listed twice, the first time with another name: the later row wins; excluded paths leave."""
    rows = tree.resolve_paths(views.entries(spark, sf), F.concat("drive", F.lit(":/"))).withColumns({"modified": F.lit(0.0), "seq": F.lit(2)})
    older = rows.withColumns({"path": F.concat("path", F.lit(".old")), "seq": F.lit(1)})
    made = catalog.populate(older.unionByName(rows))
    return catalog.remove_excluded(made, F.contains("path", F.lit("/n1"))).select("file_ref", "path")


# -- changes


@query(f"WITH {C_} SELECT drive, file_ref, usn, CASE WHEN reason & 512 <> 0 THEN 'delete' ELSE 'update' END AS decision FROM last")
def last_event_wins(spark: SparkSession, sf: str) -> DataFrame:
    return changes.last_events(views.change_log(spark, sf)).select("drive", "file_ref", "usn", "decision")


@query(f"WITH {C_} SELECT drive, count(*) FILTER (reason & 512 = 0)::BIGINT AS n_updated, count(*) FILTER (reason & 512 <> 0)::BIGINT AS n_deleted FROM last GROUP BY drive")
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changes.change_counts(views.change_log(spark, sf))


_APPLIED = f"""WITH {C_}, {views.PRESENT_SQL}, u AS (
  SELECT p.*, l.usn FROM last l JOIN present p ON p.drive = l.drive AND p.file_ref = l.file_ref WHERE reason & 512 = 0 AND NOT {views.EXCLUDED_SQL.format('path')})
SELECT drive, file_ref, path, size FROM u QUALIFY row_number() OVER (PARTITION BY drive, lower(path) ORDER BY usn DESC) = 1"""


def _gone(p: Column) -> Column:
    return paths.excluded(p, views.EXCLUDED_PATHS, views.EXCLUDED_DIRS)


@query(_APPLIED)
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """On a catalog where every changed file was at another path."""
    now = views.present(spark, sf)
    before = catalog.with_lower_name(now.select("drive", "file_ref", F.concat("path", F.lit(".old"), F.col("file_ref")).alias("path"), "name", F.lit(".txt").alias("extension"), "size", "modified", "is_dir"))
    return changes.apply_changes(before, views.change_log(spark, sf), now, _gone).select("drive", "file_ref", "path", "size")


@query(f"{_ROUTED} SELECT path, folder FROM routed")
def route_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.route_changes(_changed(spark, sf), views.folders(spark)).select("path", "folder")


@query(f"{_ROUTED} SELECT folder, count(DISTINCT path)::BIGINT AS n_pending FROM routed GROUP BY folder")
def pending_by_folder(spark: SparkSession, sf: str) -> DataFrame:
    return changes.pending_by_folder(_changed(spark, sf), views.folders(spark))


# every user's events are a journal of a drive of its own; a snapshot of each was taken at a third of them, or at its end
_JOURNALS = """j AS (SELECT 'u' || user_id AS drive, 1 + (user_id % 5 = 0)::INT AS journal_id, max(event_id) + 1 AS next_usn, min(event_id) AS lowest_usn FROM events GROUP BY user_id),
s AS (SELECT 'u' || user_id AS drive, 1 AS journal_id, CASE WHEN user_id % 3 = 0 THEN max(event_id) + 1 ELSE (min(event_id) * 2 + max(event_id)) // 3 END AS next_usn FROM events GROUP BY user_id)"""


def _journals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    user = F.col("user_id")
    ends = views.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    drive = F.concat(F.lit("u"), user).alias("drive")
    now = ends.select(drive, F.when(user % 5 == 0, 2).otherwise(1).cast("long").alias("journal_id"), (F.col("b") + 1).alias("next_usn"), F.col("a").alias("lowest_usn"))
    then = ends.select(drive, F.lit(1).cast("long").alias("journal_id"), F.when(user % 3 == 0, F.col("b") + 1).otherwise(F.floor((F.col("a") * 2 + F.col("b")) / 3)).cast("long").alias("next_usn"))
    return now, then


@query(f"WITH {C_} SELECT drive, 1::BIGINT AS journal_id, min(usn) AS lowest_usn, max(usn) + 1 AS next_usn FROM changes GROUP BY drive")
def journal_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return changes.journal_metadata(views.change_log(spark, sf))


@query(f"WITH {_JOURNALS} SELECT drive, s.next_usn AS first_usn, j.next_usn FROM s JOIN j USING (drive) WHERE s.journal_id = j.journal_id AND s.next_usn < j.next_usn")
def catchup_ranges(spark: SparkSession, sf: str) -> DataFrame:
    now, then = _journals(spark, sf)
    return changes.catchup_ranges(then, now)


@query(f"""WITH {_JOURNALS} SELECT upper(drive) AS drive, CASE WHEN j.drive IS NULL THEN s.journal_id ELSE j.journal_id END::BIGINT AS journal_id, coalesce(j.next_usn, s.next_usn) AS next_usn
FROM s LEFT JOIN (SELECT * FROM j WHERE next_usn % 2 = 0) j USING (drive)""")
def upsert_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the drives have a later offset, under the drive's name in capitals."""
    now, then = _journals(spark, sf)
    return settings.upsert_offsets(then, now.where("next_usn % 2 = 0").withColumn("drive", F.upper("drive")))


_CAUGHT_UP = f"""WITH {C_.partition(", last AS")[0].partition("," + chr(10) + "last AS")[0]},
moved AS (SELECT drive, file_ref, usn, reason FROM changes),
mid AS (SELECT (SELECT max(event_id) FROM events) // 2 AS usn),
a AS (SELECT drive, file_ref, arg_max(reason, usn) AS reason FROM moved WHERE reason & 13063 <> 0 AND usn >= (SELECT usn FROM mid) GROUP BY drive, file_ref),
refs AS (SELECT DISTINCT drive, file_ref FROM changes),
base AS (SELECT drive, file_ref, drive || ':/' || CASE WHEN drive = 'D' THEN 'listed' ELSE 'old' END || '/' || file_ref AS path FROM refs WHERE drive = 'C' OR file_ref % 3 <> 0)
SELECT drive, file_ref, CASE WHEN a.reason IS NULL THEN base.path ELSE drive || ':/new/' || file_ref END AS path
FROM base FULL JOIN a USING (drive, file_ref) WHERE a.reason IS NULL OR a.reason & 512 = 0"""


@query(_CAUGHT_UP)
def rescan_merge(spark: SparkSession, sf: str) -> DataFrame:
    """C's journal still holds its offset and is caught up; D's doesn't, so it is listed anew and the changes made meanwhile are merged in."""
    log = staged(views.change_log(spark, sf), "log")
    refs = log.select("drive", "file_ref").distinct()
    end, mid = log.agg(F.max("usn") + 1, F.floor(F.max("usn") / 2)).first()
    row = lambda folder: F.concat_ws("/", F.concat("drive", F.lit(":")), F.lit(folder), F.col("file_ref"))
    facts = lambda df, folder: df.select("drive", "file_ref", row(folder).alias("path"), F.col("file_ref").cast("string").alias("name"), F.lit("").alias("extension"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("modified"), F.lit(False).alias("is_dir"))
    listing = facts(refs.where("drive = 'D' AND file_ref % 3 <> 0"), "listed").withColumn("since_usn", F.lit(mid))
    journals = spark.createDataFrame([("C", 1, mid, end), ("D", 1, mid, end)], "drive string, journal_id long, lowest_usn long, next_usn long")
    offsets = spark.createDataFrame([("C", 1, mid), ("D", 1, mid - 1)], "drive string, journal_id long, next_usn long")
    found, _ = changes.catch_up(facts(refs, "old"), offsets, journals, log, listing, facts(refs, "new"))
    return found.select("drive", "file_ref", "path")


@query(f"WITH {C_} SELECT usn, reason & 256 <> 0 AS file_create, reason & 512 <> 0 AS file_delete, reason & 8192 <> 0 AS rename_new FROM changes WHERE reason & 13063 <> 0")
def reason_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = changes.relevant(views.change_log(spark, sf)).select("usn", changes.reason_flags(F.col("reason")).alias("f"))
    return rows.select("usn", "f.file_create", "f.file_delete", "f.rename_new")


@query("""WITH d AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT 'C:/u' || e.user_id AS folder, count(DISTINCT e.event_id % 50) FILTER (event_type <> 'purchase' AND e.event_id > coalesce(d.last, -1))::BIGINT AS n_pending
FROM events e LEFT JOIN d USING (user_id) GROUP BY e.user_id""")
def pending_drained(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of changed paths, in two files; a purchase drains its user's folder."""
    root = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"
    e = views.table(spark, sf, "events")
    top = F.concat(F.lit("C:/u"), "user_id")
    drains = F.col("event_type") == "purchase"
    rows = e.select(F.col("event_id").alias("usn"), F.when(~drains, F.concat(top, F.lit("/f"), F.col("event_id") % 50)).alias("path"), F.when(drains, top).alias("drained"))
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (F.col("usn") <= middle, F.col("usn") > middle):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = changes.drained_pending(stream, e.select(top.alias("path")).distinct(), parts=2)
        keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/at={number}")
        found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = spark.read.schema("folder string, part int, n_pending long, batch int").parquet(f"{root}/out").groupBy("folder", "part").agg(F.max_by("n_pending", "batch").alias("n"))
    return last.groupBy("folder").agg(F.sum("n").alias("n_pending"))


@query(f"""WITH {F_}, r AS (SELECT * FROM files JOIN documents ON doc_id = id), w AS (SELECT *, extension IN ('.txt', '.md', '.py', '.pdf') AND coalesce(text, '') <> '' AND NOT has_content AS stale FROM r)
SELECT count(*)::BIGINT AS listed, count(*) FILTER (stale)::BIGINT AS read, count(*) FILTER (stale AND extension = '.pdf')::BIGINT AS failed, count(*) FILTER (NOT stale)::BIGINT AS skipped FROM w""")
def reindex_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What a reindex job saw, counted while it ran; its texts come from ``documents``."""
    f, c, seen = views.files(spark, sf), views.contents(spark, sf), progress.Progress()
    of = f.join(c, F.col("id") == F.col("file_id")).select(F.col("path").alias("of_path"), F.encode("content", "UTF-8").alias("bytes"))

    def texts_of(stale: DataFrame) -> DataFrame:
        found = stale.join(of, F.col("path") == F.col("of_path")).drop("of_path")
        return sources.extract(found.withColumn("ext", paths.extension(F.col("path"))), "bytes", "ext")

    sized = c.select("file_id", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("bytes_now"))
    listing = f.join(sized, F.col("id") == F.col("file_id")).select("path", F.col("bytes_now").alias("size"), "modified")
    catalog.reindex_changed(f, c, listing, texts_of, progress=seen)
    counts = seen.counts()
    return spark.createDataFrame([tuple(counts[k] for k in ("listed", "read", "failed", "skipped"))], "listed long, read long, failed long, skipped long")


@query("SELECT event_id, CASE WHEN event_id = 0 THEN 0.0 ELSE round(event_id * 60.0::DOUBLE, 3) END AS unix FROM events")
def filetime_to_unix(spark: SparkSession, sf: str) -> DataFrame:
    ticks = F.when(F.col("event_id") == 0, F.lit(0).cast("long")).otherwise(F.col("event_id") * 600_000_000 + F.lit(116444736000000000))
    return views.table(spark, sf, "events").select("event_id", F.round(present.filetime_to_unix(ticks), 3).alias("unix"))


@query(_APPLIED)
def streaming_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The change log as a stream of files, replayed to its end; equal to one batch as each batch holds later records only."""
    root = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    log = views.change_log(spark, sf)
    log.repartitionByRange(2, "usn").sortWithinPartitions("usn").write.parquet(f"{root}/log")
    now = views.present(spark, sf)
    store = changes.CatalogStore(spark, f"{root}/catalog")
    store.start(views.catalog(spark, sf).limit(0))
    stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
    running = changes.follow(stream, store, lambda: now, f"{root}/state", _gone, available_now=True)
    running.awaitTermination()
    return store.read(running.lastProgress["batchId"] if running.lastProgress else 0).select("drive", "file_ref", "path", "size")


@query("SELECT drive, journal_id::BIGINT AS journal_id, next_usn::BIGINT AS next_usn FROM (VALUES ('C', 1, 5000), ('D', 1, 9000), ('E', 3, 500), ('F', 7, 1)) t(drive, journal_id, next_usn)")
def upsert_offsets(spark: SparkSession, sf: str) -> DataFrame:
    old = views.offsets(spark, [*views.SNAPSHOT_OFFSETS, ("f", 7, 1)])
    return settings.upsert_offsets(old, views.offsets(spark, [(d.lower(), j, u) for d, j, u in views.CURRENT_OFFSETS]))


# -- bytes


def _little(value: Column, n: int) -> Column:
    """Hex of a number's n bytes, the lowest first."""
    return F.regexp_replace(F.reverse(F.lpad(F.hex(value.cast("long")), 2 * n, "0")), "(.)(.)", "$2$1")


@query("""SELECT user_id AS file_ref, event_id AS parent_ref, event_id + 5 AS usn, 256::BIGINT AS reason, (event_id % 60)::DOUBLE AS modified, 'f' || event_id || 'é.txt' AS name FROM events""")
def usn_record(spark: SparkSession, sf: str) -> DataFrame:
    """Journal records built from events (with sequence numbers above the references' 48 bits), then decoded."""
    e = views.table(spark, sf, "events")
    name = F.encode(F.concat(F.lit("f"), "event_id", F.lit("é.txt")), "UTF-16LE")
    size = F.length(name)
    ticks = F.when(F.col("event_id") % 60 == 0, F.lit(0).cast("long")).otherwise((F.col("event_id") % 60) * 10_000_000 + F.lit(116444736000000000))
    parts = [(size + 60, 4), (F.lit(2), 2), (F.lit(0), 2), (F.col("user_id") + F.lit(3 << 48), 8), (F.col("event_id") + F.lit(1 << 48), 8), (F.col("event_id") + 5, 8), (ticks, 8), (F.lit(256), 4), (F.lit(0), 8), (F.lit(32), 4), (size, 2), (F.lit(60), 2)]
    record = F.concat(F.unhex(F.concat(*(_little(v, n) for v, n in parts))), name)
    return records.journal_records(e.select(record.alias("record"))).select("file_ref", "parent_ref", "usn", "reason", "modified", "name")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def extract_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as UTF-8 files, through the extraction route."""
    f = views.contents(spark, sf).select(F.col("file_id").alias("doc_id"), F.lit(".md").alias("extension"), F.encode("content", "UTF-8").alias("content"))
    return sources.extract(f).select("doc_id", F.md5("text").alias("text_md5"))


_FORMAT = "CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.hwp' ELSE '.odd' END"


@query(f"SELECT doc_id, ext, CASE WHEN doc_id % 4 IN (0, 3) THEN md5(text) END AS text_md5 FROM (SELECT *, {_FORMAT} AS ext FROM documents)")
def extract_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats without a reader give no text; unknown ones are decoded as plain text."""
    f = views.table(spark, sf, "documents").select("doc_id", F.expr(_FORMAT).alias("ext"), F.encode("text", "UTF-8").alias("content"))
    return sources.extract(f, extension_col="ext").select("doc_id", "ext", F.md5("text").alias("text_md5"))


_OFFICE = r"""WITH lines AS (
  SELECT doc_id, line, i, CASE WHEN doc_id % 8 IN (2, 3, 7) THEN regexp_replace(line, '^\s+|\s+$', '', 'g') ELSE line END AS kept
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
found AS (
  SELECT doc_id, string_agg(CASE WHEN doc_id % 8 = 7 THEN replace(replace(replace(kept, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ELSE kept END, chr(10)
    ORDER BY CASE WHEN doc_id % 8 = 7 AND i <= n // 2 THEN i + n ELSE i END) AS text
  FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS n FROM lines) WHERE regexp_matches(line, '\S') AND doc_id % 8 NOT IN (4, 5, 6) GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 4) THEN '.docx' WHEN doc_id % 8 IN (1, 5) THEN '.xlsx' WHEN doc_id % 8 = 3 THEN '.hwpx' ELSE '.pptx' END AS ext, md5(found.text) AS text_md5
FROM documents LEFT JOIN found USING (doc_id)"""


@query(_OFFICE)
def extract_office(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as office files; broken, encrypted and empty ones give null."""
    return sources.extract(samples.office_files(spark, sf), extension_col="ext").select("doc_id", "ext", F.md5("text").alias("text_md5"))


# Fixed values of the test: letters, and accented ones that the index stores as them; the last two have two marks and stay.
_PLAIN_LETTERS, _ACCENTED_LETTERS = "aeinostuyAEIOlr", "ạẽỉṅọṣṭųỹẢẺỊȌǟǖ"
_TOKENIZED = r"""WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(strip_accents(lower(translate(text, 'lr', chr(57344) || chr(57345)))), chr(57344) || chr(57345), 'ǟǖ'), '[\p{L}\p{N}]+') AS toks FROM documents)
SELECT doc_id, len(toks)::BIGINT AS n, md5(array_to_string(toks, ' ')) AS toks_md5 FROM t"""


@query(_TOKENIZED)
def tokenize_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written with accented letters have the tokens of the plain ones."""
    found = text.tokens(F.translate("text", _PLAIN_LETTERS, _ACCENTED_LETTERS))
    return views.table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("toks_md5"))


_SPELLED = r"""CASE event_id % 10 WHEN 0 THEN 'C:\Windows\u' WHEN 1 THEN 'c:/WINDOWS/u' WHEN 2 THEN 'C:/Program Files (x86)/u' WHEN 3 THEN 'C:/Users/Default//u' WHEN 4 THEN 'C:\Users\me\AppData\u'
  WHEN 5 THEN 'D:/Windows/u' WHEN 6 THEN 'C:/Windowsx/u' WHEN 7 THEN 'C:/x/../Windows/u' WHEN 8 THEN 'C:/docs/~$u' ELSE 'C:/docs/u' END"""


@query("SELECT event_id, event_id % 10 IN (5, 6, 9) AS kept FROM events")
def default_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """The default exclusions, whatever a path's slashes, case and dots."""
    spelled = F.concat(F.expr(_SPELLED.replace("\\", "\\\\")), F.col("user_id"))
    gone = paths.excluded(spelled, paths.default_excluded_paths("C:\\Users\\me"), paths.EXCLUDED_DIRS)
    return views.table(spark, sf, "events").select("event_id", (~gone).alias("kept"))


# -- presentation


@query("""SELECT event_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END AS shown
FROM (SELECT event_id, event_id * event_id * 37 + 3 AS s FROM events)""")
def format_size(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events").select("event_id", present.format_size(F.col("event_id") * F.col("event_id") * 37 + 3).alias("shown"))


@query(f"""WITH {F_} SELECT id, name, regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f KB', size / 1024.0) END AS size_shown,
  strftime(make_timestamp((modified * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS modified_shown, extension, 'file name' AS label FROM files""")
def result_display(spark: SparkSession, sf: str) -> DataFrame:
    f = views.files(spark, sf)
    return f.select("id", "name", paths.dirname(F.col("path")).alias("folder"), present.format_size(F.col("size")).alias("size_shown"), present.format_time(F.col("modified")).alias("modified_shown"), "extension", present.match_label(F.lit("filename")).alias("label"))


_MARKED = rf"""WITH cut AS (
  SELECT page_id, replace(replace(replace(replace(replace(substr(html, 1, {present.PREVIEW_CHARS}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM pages),
parts AS (SELECT page_id, regexp_split_to_array(t, '(?i)the|div') AS between, regexp_extract_all(t, '(?i)the|div') AS hits FROM cut)
SELECT page_id, replace(array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || CASE WHEN i > len(hits) THEN '' WHEN i <= {present.MAX_HIGHLIGHTS} THEN '<b>' || hits[i] || '</b>' ELSE hits[i] END), ''), chr(10), '<br>') AS html FROM parts"""
_PREVIEWED = f"SELECT doc_id, md5(substr(text, 1, {present.PREVIEW_CHARS})) AS shown, length(text) > {present.PREVIEW_CHARS} AS was_cut FROM documents"


@query(_MARKED)
def highlight_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the preview shows them, at the operator's own limits."""
    cut, _ = present.preview(F.col("html"))
    return views.table(spark, sf, "pages").select("page_id", present.highlight(cut, present.highlight_terms("the OR div*")).alias("html"))


@query(_MARKED)
def highlight_page(spark: SparkSession, sf: str) -> DataFrame:
    return highlight_snippet(spark, sf)


@query(f"SELECT page_id, regexp_replace(html, '<b>', '{present.FIRST_MATCH}<b>') AS html FROM ({_MARKED})")
def highlight_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Marked pages with an anchor at the first mark, to which a preview scrolls."""
    cut, _ = present.preview(F.col("html"))
    return views.table(spark, sf, "pages").select("page_id", present.highlight(cut, present.highlight_terms("the OR div*"), anchor=present.FIRST_MATCH).alias("html"))


@query(_PREVIEWED)
def preview_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as the preview shows them, at the operator's own limit."""
    shown, cut = present.preview(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", F.md5(shown).alias("shown"), cut.alias("was_cut"))


@query(_PREVIEWED)
def preview_document(spark: SparkSession, sf: str) -> DataFrame:
    return preview_truncate(spark, sf)


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'the'))::INTEGER AS n FROM documents")
def find_count(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", present.find_count(F.col("text"), "The").alias("n"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return bm25_topk(spark, sf)


HEADLINE = ("name_glob", "content_search", "bm25_topk", "name_and_content", "token_doc_freq", "postings_phrase", "resolve_paths", "apply_changes", "upsert_diff")
