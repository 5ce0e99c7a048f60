"""The stored index: ranks as of a rebuild and as FTS5's, changes at the cost of what changed, blocks that are skipped."""

import os
import random
import shutil
import sqlite3

import pytest

from loupe.operators import index, postings, search
from loupe.operators.match import first, near, phrase, plain, prefix, word
from test_search import CASES, WORDS

TEXT = "id long, content string"


def texts(n, seed, rare=()):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices([*WORDS, *rare], k=rng.randint(0, 30)))) for i in range(n)]


def ranks(rows):
    return {r["doc_id"]: r["rank"] for r in rows.collect()}


def fts5(rows):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", rows)
    return db


def like_fts5(kept, db, query, match):
    want = {r[0]: r[1] for r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (match,))}
    got = ranks(kept.search(query))
    assert got.keys() == want.keys(), match
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [*texts(150, 5), (150, None), (151, "main.py"), (152, "Été alpha"), (153, "alpha x x x beta"), (154, "the the the")]
    kept = index.Index(spark, str(tmp_path_factory.mktemp("index")), ["content"])
    kept.replace(spark.createDataFrame(rows, TEXT), "id")
    return kept, fts5(rows)


@pytest.mark.parametrize(("ours", "theirs"), CASES, ids=[c[1] for c in CASES])
def test_searches_like_fts5(stored, ours, theirs):
    like_fts5(*stored, ours, theirs)


def test_random_near_queries_like_fts5(stored):
    rng = random.Random(2)
    for _ in range(12):
        parts = [" ".join(rng.choices(WORDS, k=rng.choice([1, 1, 2]))) for _ in range(rng.choice([2, 2, 3]))]
        gap = rng.randint(0, 6)
        like_fts5(*stored, near(*parts, gap=gap), f"NEAR({' '.join(chr(34) + p + chr(34) for p in parts)}, {gap})")


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_changes_write_what_changed_and_rank_like_a_rebuild(spark, tmp_path):
    rows = dict(texts(3000, 1, [f"w{k}" for k in range(800)]))
    kept = index.Index(spark, str(tmp_path / "i"), ["content"])
    kept.replace(spark.createDataFrame(list(rows.items()), TEXT), "id")
    whole = size_of(tmp_path / "i")
    new = {i: f"alpha new{i} beta" for i in (3, 77, 2999, 5000)} | {8: None}
    kept.replace(spark.createDataFrame(list(new.items()), TEXT), "id")
    written = sum(size_of(tmp_path / "i" / t / "segment=1") for t in ("postings", "blocks", "gone"))
    assert written < whole / 10
    kept.remove(spark.createDataFrame([(4,), (2999,), (9999,)], "gone long"), "gone")
    kept.replace(spark.createDataFrame([(4, "back the alpha")], TEXT), "id")
    rows |= new | {4: "back the alpha"}
    del rows[2999]
    db = fts5(list(rows.items()))

    def check():
        for query, theirs in [(word("alpha"), "alpha"), (word("the") - prefix("new"), "the NOT new*"), (near("alpha", "beta", gap=2), "NEAR(alpha beta, 2)"), (phrase("alpha beta") | word("back"), '"alpha beta" OR back'), (first("alpha"), "^alpha")]:
            like_fts5(kept, db, query, theirs)
        now = kept.manifest()
        assert now.n_docs == len(rows) == kept.documents().count()

    check()
    assert kept.manifest().segments == [0, 1, 2, 3]
    kept.compact(2)
    assert len(kept.manifest().segments) == 2 and 0 in kept.manifest().segments  # the large one wasn't rewritten
    check()
    kept.compact(1)
    assert not kept.manifest().has_dead
    kept.clean()
    assert len(os.listdir(tmp_path / "i" / "postings")) == 1
    check()


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path):
    kept = index.Index(spark, str(tmp_path / "i"), ["content"])
    assert kept.search(word("a")).count() == 0 and kept.manifest().n_docs == 0
    kept.replace(spark.createDataFrame([(1, "a b"), (2, "a")], TEXT), "id")
    before = ranks(kept.search(word("a")))
    kept.replace(spark.createDataFrame([(1, "c")], TEXT), "id")
    shutil.rmtree(tmp_path / "i" / "manifest" / "at=1")
    assert ranks(kept.search(word("a"))) == before
    kept.replace(spark.createDataFrame([(2, "c")], TEXT), "id")  # takes the same number
    assert ranks(kept.search(word("a"))).keys() == {1} and ranks(kept.search(word("c"))).keys() == {2}


def test_top_skips_blocks_and_finds_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    rng = random.Random(4)
    rows = [(i, " ".join(["filler"] * rng.randint(40, 60) + ["rare"] * (i % 11 == 0) + ["some"] * (i % 3 == 0))) for i in range(1500)]
    rows += [(2000 + i, "rare rare some") for i in range(6)]
    kept = index.Index(spark, str(tmp_path / "i"), ["content"])
    kept.replace(spark.createDataFrame(rows, TEXT), "id")

    def same(query, k):
        best, report = kept.top(query, k, count_blocks=True)
        want = sorted((r, i) for i, r in ranks(kept.search(query)).items())[:k]
        assert [(pytest.approx(r, abs=1e-9), i) for r, i in want] == [(r["rank"], r["doc_id"]) for r in best.collect()]
        return report

    report = same(word("rare"), 5)
    assert 0 < report["read"] < report["blocks"] / 4
    same(word("rare") & word("some"), 7), same(word("rare") | word("some"), 9), same(word("some") - word("rare"), 400), same(word("none"), 3), same(prefix("ra"), 5)
    kept.replace(spark.createDataFrame([(2000, "gone"), (2001, "rare")], TEXT), "id")
    same(word("rare"), 5), same(word("rare") | word("some"), 2000)


def test_search_over_stored_files_and_texts(spark, tmp_path):
    files = spark.createDataFrame([(1, "C:/x/alpha.txt", "alpha.txt", ".txt", 10, 1.0), (2, "C:/x/beta.txt", "beta.txt", None, None, None), (3, "C:/y/alpha2.txt", "alpha2.txt", ".txt", 5, 2.0)], "id long, path string, name string, extension string, size long, modified double")
    contents = spark.createDataFrame([(1, "gamma gamma"), (2, "gamma"), (3, None)], "file_id long, content string")
    names, book = index.Index(spark, str(tmp_path / "n"), ["name", "path"]), index.Index(spark, str(tmp_path / "c"), ["content"])
    names.replace(files, "id"), book.replace(contents, "file_id")
    stored = search.StoredFiles(files, names)
    for asked in [{"names": "alpha"}, {"contents": "gamma"}, {"names": "alpha", "contents": "gamma"}, {"names": word("x").within("path"), "folders": ["c:/X"]}, {"names": "-", "contents": "gamma"}, {"contents": plain("gam"), "limit": 1}]:
        assert search.search(stored, book, **asked).collect() == search.search(search.index_files(files), search.index_contents(contents), **asked).collect()


def test_one_scan_feeds_counts_and_rows(stored):
    plan = stored[0].search(word("alpha") & phrase("beta gamma"))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_scores_of_plain_postings_take_near(spark):
    rows = spark.createDataFrame(texts(40, 8), TEXT)
    book, lengths = postings.build(rows, "id", ["content"]), postings.lengths(rows, "id", ["content"])
    want = {r["id"]: r["rank"] for r in search.score(search.with_tokens(rows, ["content"]), ["content"], near("alpha", "the", gap=3)).collect()}
    got = {r["doc_id"]: r["rank"] for r in postings.score(book, lengths, near("alpha", "the", gap=3)).collect()}
    assert got == pytest.approx(want)


def test_occurrences_within_a_row(spark):
    """Postings are made without a shuffle, and hold every position of every token."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c dd é E 7".split()) for _ in range(n))) for i, n in enumerate([0, 1, 2, 50, 3000])] + [(9, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    built = postings.build(docs, "id", ["text"])
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in rows:
        for p, w in enumerate((t or "").lower().replace("é", "e").split()):
            want.setdefault((w, "text", i), []).append(p)
    assert {(r["token"], r["column"], r["doc_id"]): r["positions"] for r in built.collect()} == want


def test_a_block_holds_a_token_in_one_row(spark, tmp_path):
    """Stored rows are fewer than postings by far, and give the same postings as each document does, before and after a merge."""
    rows = [*texts(600, 3, ["été"]), (600, None), (601, ""), (602, "alpha " * 3000)]
    docs = spark.createDataFrame(rows, TEXT).coalesce(1)
    want = sorted(tuple(r) for r in postings.build(docs, "id", ["content"]).select("token", "column", "doc_id", "positions").collect())
    kept = index.Index(spark, str(tmp_path / "i"), ["content"])
    kept.replace(docs, "id")
    held = lambda: sorted(tuple(r) for r in kept.postings().select("token", "column", "doc_id", "positions").collect())
    assert held() == want and kept.documents().count() == len(rows)
    assert spark.read.parquet(str(tmp_path / "i" / "postings" / "segment=0")).count() < len(want) / 20
    kept.replace(docs.where("id >= 300"), "id")
    kept.compact(1)
    assert held() == want and kept.manifest().segments == [2]
    assert spark.read.parquet(str(tmp_path / "i" / "postings" / "segment=2")).count() < len(want) / 20
