"""Full-text conditions, ranks and result order; SQLite's FTS5 is the differential oracle."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loupe.functions.text import token_text
from loupe.operators import postings, search
from loupe.operators.match import first, near, phrase, plain, prefix, word

WORDS = "alpha beta gamma delta main mains py report reports of the".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))) for i in range(120)]
    return rows + [(120, "main.py"), (121, "main pyx"), (122, "mainx py"), (123, "py main"), (124, "Été alpha"), (125, "alpha x x x beta"), (126, "the the the")]


@pytest.fixture(scope="module")
def fts(corpus):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", corpus)
    return db


@pytest.fixture(scope="module")
def indexed(spark, corpus):
    return search.with_tokens(spark.createDataFrame(corpus, "id long, content string"), ["content"]).cache()


CASES = [
    (word("alpha"), "alpha"), (word("the"), "the"), (prefix("rep"), "rep*"), (phrase("alpha beta"), '"alpha beta"'), (phrase("main.py", prefix=True), '"main.py"*'),
    (word("alpha") & word("beta"), "alpha AND beta"), (word("alpha") | (word("beta") & word("gamma")), "alpha OR beta AND gamma"), (word("alpha") - word("beta"), "alpha NOT beta"),
    ((word("alpha") | word("delta")) - (phrase("of the") | word("py")), '(alpha OR delta) NOT ("of the" OR py)'), (first("alpha"), "^alpha"), (first("the of"), '^"the of"'),
    (near("alpha", "beta", gap=3), "NEAR(alpha beta, 3)"), (near("alpha", "beta", gap=2), "NEAR(alpha beta, 2)"), (near("alpha beta", "gamma", gap=1), 'NEAR("alpha beta" gamma, 1)'), (near("main", "py"), "NEAR(main py)"),
    (phrase("the the"), '"the the"'), (word("été"), "été"), (prefix("m") & prefix("p") & word("of"), "m* p* of"), (near("alpha", "beta", gap=4) & word("the"), "NEAR(alpha beta, 4) AND the"),
]


@pytest.mark.parametrize(("ours", "theirs"), CASES, ids=[c[1] for c in CASES])
def test_matches_and_ranks_like_fts5(indexed, fts, ours, theirs):
    want = {r[0]: r[1] for r in fts.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (theirs,))}
    got = {r["id"]: r["rank"] for r in search.score(indexed, ["content"], ours).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_random_queries_like_fts5(indexed, fts):
    rng = random.Random(9)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            w = rng.choice(WORDS)
            return rng.choice([(word(w), w), (prefix(w[:3]), w[:3] + "*"), (phrase(f"{w} beta"), f'"{w} beta"')])
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        return rng.choice([(a & b, f"({x}) AND ({y})"), (a | b, f"({x}) OR ({y})"), (a - b, f"({x}) NOT ({y})")])

    toks = {"content": F.col("content_tokens")}
    trees = [tree(3) for _ in range(25)]
    flags = indexed.select("id", *(q.matches(toks).alias(f"q{k}") for k, (q, _) in enumerate(trees))).collect()
    for k, (_, sql) in enumerate(trees):
        want = {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (sql,))}
        assert {r["id"] for r in flags if r[f"q{k}"]} == want, sql


def test_two_columns(spark):
    rows = [(1, "main", "py"), (2, "main.py", "x"), (3, "x", "a/main/py")]
    toks = {c: token_text(F.col(c)) for c in ("name", "path")}
    frame = spark.createDataFrame(rows, "id long, name string, path string")
    ids = lambda q: [r["id"] for r in frame.where(q.matches(toks)).orderBy("id").collect()]
    assert ids(plain("main.py")) == [2, 3] and ids(word("main")) == [1, 2, 3] and ids(word("main").within("path")) == [3]


def test_plain_route():
    assert plain("main.py my") == phrase("main.py", prefix=True) & prefix("my")
    assert plain("  ** - ") is None and plain("") is None and plain("report*") == prefix("report")


NAMES = ["Report.docx", "report10.docx", "main.py", "Main.PY", "data[1].csv", "a b", "doc"]


@pytest.mark.parametrize(("query", "found"), [("report??.docx", ["report10.docx"]), ("*.py", ["main.py", "Main.PY"]), ("MAIN", ["main.py", "Main.PY"]), ("rep docx", ["Report.docx", "report10.docx"]), ("data[1]*", ["data[1].csv"]), ("do?", ["doc"]), ("  ", NAMES), ("*.py ain", ["main.py", "Main.PY"])])
def test_names(spark, query, found):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert sorted(r[0] for r in rows.where(search.name_matches(query, F.lower("name"))).collect()) == sorted(found)


def files(spark):
    rows = [(1, "C:/x/alpha.txt", "alpha.txt", ".txt", 10, 1.0), (2, "C:/x/beta.txt", "beta.txt", None, None, None), (3, "C:/y/alpha2.txt", "alpha2.txt", ".txt", 5, 2.0), (4, "C:/x_/z.txt", "z.txt", ".txt", 7, 3.0)]
    return spark.createDataFrame(rows, "id long, path string, name string, extension string, size long, modified double")


def test_search_merges_and_orders(spark):
    f = search.index_files(files(spark))
    c = search.index_contents(spark.createDataFrame([(1, "gamma gamma"), (2, "gamma"), (4, "other")], "file_id long, content string"))
    both = search.search(f, c, names="alpha", contents="gamma").collect()
    assert [(r["file_id"], r["match_type"]) for r in both] == [(1, "both")]
    merged = search.ordered(search.merge(search._result(search.search_names(f, "alpha"), "id", F.lit(False)), search._result(search.search_contents(c, files(spark), "gamma"), "id", F.lit(False))))
    assert [(r["file_id"], r["match_type"]) for r in merged.collect()] == [(1, "both"), (3, "filename"), (2, "content")]
    scoped = search.search(f, c, contents="gamma OR".split()[0], folders=["C:/X"]).collect()
    assert [(r["file_id"], r["extension"], r["size"]) for r in scoped] == [(1, ".txt", 10), (2, "", 0)]
    assert search.search(f, c, names="-", contents="gamma").count() == 0
    assert search.search(f, c, contents="gamma", limit=1).count() == 1


def test_sort_and_page(spark):
    rows = spark.createDataFrame([(1, "b", "/d/b", ".x", 3, 1.0, "filename", False), (2, "A", "/d/A", ".y", 9, 2.0, "filename", False), (3, "z", "/z", "", 0, 3.0, "filename", True)], "file_id long, name string, path string, extension string, size long, modified double, match_type string, is_dir boolean")
    order = lambda *a, **k: [r["file_id"] for r in search.sort_results(rows, *a, **k).collect()]
    assert order() == [3, 2, 1] and order("size", descending=True) == [3, 2, 1] and order("size", descending=True, folders_last_when_descending=True) == [2, 1, 3]
    assert [r["file_id"] for r in search.page(search.sort_results(rows), 1, 1).collect()] == [2] and search.page(rows, 9, 2).count() == 0


def test_postings(spark, corpus, fts, tmp_path):
    docs = spark.createDataFrame(corpus, "id long, content string")
    postings.write(postings.build(docs, "id", ["content"]), str(tmp_path / "p"))
    book = spark.read.parquet(str(tmp_path / "p"))
    hits = {r["doc_id"]: r["hits"] for r in postings.phrase_documents(book, ["the", "the"]).collect()}
    assert hits[126] == 2 and hits.keys() == {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH '\"the the\"'")}
    assert {r[0] for r in postings.documents_with(book, ["alpha", "rep"], prefix=True).collect()} == {r[0] for r in fts.execute("SELECT rowid FROM t WHERE t MATCH 'alpha rep*'")}
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,alpha)" in postings.documents_with(book, ["alpha"])._jdf.queryExecution().toString()
