"""Quality rules, line dedup, mixing, license scans: against plain Python, with edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm import license_scan, line_dedup, lm_score, mixing, near_dup, quality

SCHEMA = "doc_id long, text string, lang string, source string, row string, copy int, id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "shared line of boilerplate text that many documents hold"

TEXTS = [
    None, "", " \n\t ", "a", "one two three", "x\r\ny\x0bz", "ein Wort ﬁ ß É 日本語 𝒳",
    "a b c d e a b c d e f", "same same same same same same same", "l1 x\nl1 x\nl1 x\n\n\nother # $ % & | < >",
    "word " * 30_000 + "end", LONG + "\nown 1", "  " + LONG.upper() + "\t\nown 2\n" + LONG, LONG, "x\n" + LONG, LONG + "\n" + LONG, "own\n" + LONG,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", "r", 7, -1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id " + LONG, None, None, None, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_quality(t):
    t = t or ""
    words = WORD.findall(t)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(runs)
    inside = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(inside))


def test_quality_measures(docs):
    got = sorted(tuple(r) for r in quality.measure(docs.where("doc_id IS NOT NULL")).collect())
    want = sorted((i, *brute_quality(t)) for i, t in [*enumerate(TEXTS), (7, TEXTS[7]), (7, TEXTS[7])])
    assert got == want


def test_quality_ledger_and_ablations(spark, docs):
    book = quality.ledger(docs)
    rows = book.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        m = r.asDict()
        fails = [m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], 0 < m["n_words"] and m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 30 * m["n_words"], 2 * m["n_symbols"] > m["n_words"], 2 * m["n_dup_lines"] > m["n_lines"]]
        assert r["failed_rules"] == sum(1 << k for k, f in enumerate(fails) if f)
    table = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality.ablations(book, "v2").collect()}
    for k, rule in enumerate(quality.RULES):
        assert table[rule] == (sum(r["failed_rules"] >> k & 1 for r in rows), sum(r["failed_rules"] == 1 << k for r in rows))
    assert quality.ledger(empty(spark)).count() == 0


def brute_lines(rows, min_docs=5, min_chars=40):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    held = {}
    for i, t in rows:
        for key in {lower(strip(x)) for x in (t or "").split("\n")}:
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(i if i is not None else -(1 << 63))
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(lower(strip(x)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "shard_keys": 1, "route_rows": 3}])
def test_line_dedup(docs, options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.probe(docs, **options).collect()
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str) == brute_lines(rows)
    assert {r["row"]["row"] for r in got} == {"r", None}


def thue_morse(bits, a="a", b="b"):
    x = "0"
    for _ in range(bits):
        x += x.translate(str.maketrans("01", "10"))
    return x.replace("0", a).replace("1", b), x.replace("0", b).replace("1", a)


def test_texts_made_to_collide_stay_apart(spark):
    """Thue-Morse words collide under any polynomial modulo 2^64."""
    for bits in (10, 12, 13):
        x, y = thue_morse(bits)
        docs = spark.createDataFrame([*((i, x) for i in range(3)), *((i, y) for i in range(3, 6)), (8, f"{x}\n{y}")], "doc_id long, text string")
        assert {r["n_dropped"] for r in line_dedup.probe(docs).collect()} == {0}
        measures = quality.measure(docs.where("doc_id = 8")).first()
        assert (measures["n_words"], measures["n_dup_lines"]) == (2, 0)
        if bits == 10:
            found = {r["id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
            assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 8: 8}
            known = {r["id"]: r["n_known"] for r in lm_score.score(docs, "doc_id < 3").collect()}
            assert known == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 8: 2}


def test_lines_that_share_half_a_key():
    """Both stay in the index, and lines whose bytes aren't UTF-8 are kept as they are."""
    h1 = np.array([7, 7, 9], np.uint64)
    batch = line_dedup.pa.table({"h1": h1.view(np.int64), "h2": [1, 2, 3], "n_docs": [5, 6, 7], "last_id": [10, 20, 30], "shard": np.zeros(3, np.int32)}).to_batches()
    rows = [r for b in line_dedup._build_shards(iter(batch)) for r in b.to_pylist()]
    found, last = line_dedup.Shards(rows, 1).last_ids(np.array([7, 7, 9, 7], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert found.tolist() == [True, True, True, False] and last[:3].tolist() == [10, 20, 30]


def test_lines_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61ff62') AS string) AS text")
    assert line_dedup.drop_lines(docs).selectExpr("hex(text) AS h").first()["h"] == "61FF62"


def test_line_dedup_many_keys(spark):
    rng = np.random.default_rng(1)
    lines = [f"line number {i} padded so that it is long enough to count" for i in range(400)]
    rows = [(i, "\n".join(lines[j] for j in rng.integers(0, 400, 30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for options in ({}, {"shard_keys": 50}, {"shard_keys": 50, "max_broadcast_bytes": 0, "route_rows": 200}):
        got = line_dedup.probe(docs, **options).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    digest = line_dedup.probe(docs, digest=True).select("row.doc_id", "kept").collect()
    assert dict(map(tuple, digest)) == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in want}
    assert line_dedup.drop_lines(empty(spark)).columns == empty(spark).columns


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    slots = line_dedup.mph_slot(*line_dedup.build_mph(keys), keys)
    assert sorted(slots) == list(range(5000))


def test_mixing(spark, docs):
    mixed = mixing.mix_sources(docs, {"s0": 3.0, "s1": 0.0}).drop("shuffle_key").collect()
    salted = mixing.mix_sources(docs, {"s0": 3.0, "s1": 0.0}, max_broadcast=1, salts=3).drop("shuffle_key").collect()
    assert sorted(map(str, mixed)) == sorted(map(str, salted))
    blocks = mixing.mix_sources(docs, {"s0": 3.0, "s1": 0.0}, many=1).drop("shuffle_key").collect()
    assert sorted(map(str, mixed)) == sorted(map(str, blocks))
    many = {f"x{i}": 2.0 for i in range(3000)} | {"s0": 3.0, "s1": None}
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix_sources(docs, many).drop("shuffle_key").collect()))
    assert not any(r["source"] == "s1" for r in mixed)
    assert mixing.mix_sources(empty(spark)).count() == 0
    n = {r["source"]: r for r in mixing.source_rates(docs, "source", {"s0": 3.0}).withColumnRenamed("source_key", "source").collect()}
    assert abs(sum(r["target_share"] for r in n.values()) - 1) < 1e-9 and None in n


def test_mixing_follows_poisson(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    copies = {r["source"]: r["n"] for r in mixing.mix_sources(table).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(copies["small"] - 10_000) < 600 and abs(copies["large"] - 10_000) < 600
    per_doc = mixing.mix_sources(table).where("source = 'small'").groupBy("doc_id").count().groupBy("count").count().collect()
    shares = {r[0]: r[1] / 2000 for r in per_doc}
    assert abs(shares[5] - 0.1755) < 0.04 and abs(shares[3] - 0.1404) < 0.04
    rare = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("large").alias("source"))
    copies = [r["n"] for r in mixing.mix_sources(rare).where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(copies) == 3 and abs(sum(copies) - 1500) < 200 and max(abs(c - 500) for c in copies) < 120
    plan = mixing.mix_sources(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(900.0)).alias("s")).first()[0]
    assert abs(steps[-1] - 1) < 1e-9 and abs(steps[900] - 0.5089) < 1e-3


def base_places(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    starts = [i for p in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None)


def test_licenses(spark):
    mit = license_scan.TEMPLATES[2][1]
    edited = mit.replace("free of charge, ", "entirely free of any charge, ").replace("without limitation", "with no limitation")
    rows = [
        (1, "start " + edited + " end"), (2, "Released under the\nMIT-License. MIT license"), (3, "nothing here but a license and mit"), (4, None), (5, ""),
        (6, "this work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."), (7, "words only"), (None, "Apache License"), (8, ("filler " * 40 + "MIT License ") * 300),
        (2, "Released under the\nMIT-License. MIT license"), (9, "permission is granted to anyone who likes the software"),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        r = next(r for r in got if r["id"] == i and r["n_words"] == base_places(t)[0])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == base_places(t)
    labels = {(r["id"], r["n_words"] == 2): r["labels"] for r in got}
    assert labels[1, False] == "mit" and labels[6, False] == "gpl" and labels[7, False] == "cc-by-nc" and labels[7, True] == "" and labels[None, True] == "apache"
    assert labels[3, False] == labels[4, False] == labels[9, False] == ""
    assert all(0 <= r["score"] <= 1 for r in got)
    spans = license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("id = 1").collect()
    assert [(s["label"], s["start"]) for s in spans] == [("mit", 1)] and spans[0]["similarity"] > 0.8
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def common(a, b):
    """Length of the longest common subsequence of two lists of words."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_license_labels_against_plain_alignment(spark):
    """Long notices planted with few or with many words changed: labels and scores follow the best alignment of any window."""
    rng = random.Random(12)
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    long_ones = [(label, words_of(t)) for label, t in license_scan.TEMPLATES if len(words_of(t)) >= 12]
    rows, planted = [], {}
    for i in range(60):
        text, here = [], []
        for _ in range(rng.randint(0, 3)):
            label, notice = rng.choice(long_ones)
            keep = rng.choice([1.0, 0.95, 0.3])
            text += rng.choices(["lorem", "ipsum", "dolor", "sit"], k=rng.randint(5, 30)) + [w if rng.random() < keep else rng.choice("qwxyz") * 3 for w in notice]
            here.append((label, notice))
        rows.append((i, " ".join([*text, "end"])))
        planted[i] = here
    got = {r["id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clear = 0
    for i, t in rows:
        have, best = t.split(), {}
        for label, notice in planted[i]:
            n = len(notice)
            share = max(common(have[at : at + n + n // 4], notice) / n for at in range(max(1, len(have) - n + 1)))
            best[label] = max(best.get(label, 0), share)
        sure, never = {x for x, s in best.items() if s >= 0.85}, {x for x, s in best.items() if s < 0.55}
        labels = set(filter(None, got[i]["labels"].split(",")))
        assert sure <= labels and not never & labels and labels <= set(best)
        assert got[i]["score"] <= max(best.values(), default=0) + 1e-9 or got[i]["n_base"]
        assert not sure or got[i]["score"] >= 0.7
        clear += len(sure) + len(never)
    assert clear > 60


def test_mixing_replaces_columns_of_its_names(spark):
    rows = [(i, "s", f"t{i}", "mine", 5) for i in range(50)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string, copy string, shuffle_key int"))
    assert mixed.columns == ["doc_id", "source", "text", "copy", "shuffle_key"]
    assert dict(mixed.dtypes)["copy"] == "int" and mixed.where("copy IS NULL OR copy < 1").count() == 0
