"""Names by their pieces: the same rows as a scan, from fewer of the stored ones."""

import random

import pytest
from pyspark.sql import functions as F

from loupe.operators import names, search

WORDS = ["report", "Data", "img", "résumé", "a", "x1", "final", "[draft]"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, rng.choice(["_", "-", " "]).join(rng.choices(WORDS, k=rng.randint(1, 4))) + rng.choice([".txt", ".PY", ""])) for i in range(900)]
    rows += [(1000, ""), (1001, None), (1002, "ab"), (1003, "aaaaaa"), (1004, "zzz_only.docx")]
    frame = spark.createDataFrame(rows, "id long, name string")
    kept = names.NameIndex(spark, str(tmp_path_factory.mktemp("names")))
    kept.build(frame, files=4)
    return kept, frame


@pytest.mark.parametrize("query", ["report", "DATA*.py", "*é*", "r?port", "img final", "a", "", "*", "[draft]", "aaa", "x1?final*", "zzz", "nothing here", "fin*aft", "t.t", "ab"])
def test_same_rows_as_a_scan(stored, query):
    kept, frame = stored
    want = {r["id"] for r in frame.where(search.name_matches(query, F.lower(F.coalesce("name", F.lit(""))))).collect()}
    assert {r["id"] for r in kept.search(query).collect()} == want


def test_pieces():
    assert names.grams_of("Rep*ort a?bcd xy") == ["bcd", "ort", "rep"] and names.grams_of("a* b?") == []


def test_reads_candidate_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(names, "BLOCK_NAMES", 16)
    monkeypatch.setattr(names, "_ROW_GROUP", 1 << 10)
    kept = names.NameIndex(spark, str(tmp_path / "n"))
    kept.build(spark.createDataFrame([(i, f"n{i:05d}.txt") for i in range(20_000)], "id long, name string"), files=8)
    found = kept.search("N01234*.txt")
    assert [tuple(r) for r in found.collect()] == [(1234, "n01234.txt")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(block" in plan or "EqualTo(block" in plan
    scanned = kept.names().where(F.col("block").isin([r["block"] for r in kept.candidates(names.grams_of("n01234*.txt")).collect()]))
    assert len({r[0] for r in scanned.select(F.input_file_name()).distinct().collect()}) == 1 and scanned.count() <= 16
