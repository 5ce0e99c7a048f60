"""Near duplicates and exact search against brute force, and the pipeline's stages."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loupe.llm import components, mixing, mtree, near_dup, shared
from test_text_operators import brute_lines


def shingles(t, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_components(rows, width, percent=80):
    ids = [i for i, _ in rows]
    sets = [shingles(t, width) for _, t in rows]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True))


def near_rows(n_groups=6, copies=25, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = list(rng.choice(vocabulary, 40))
    rows = []
    for _ in range(n_groups):
        center = [*rng.choice(vocabulary, 120), *common]
        for c in range(copies):
            words = list(center)
            for p in rng.integers(0, 160, c % 9):
                words[p] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [None, "", " ", "one two", "One  two", "one two three", rows[0], rows[0].upper(), "w " * 30_000]
    rows += [" ".join([*rng.choice(vocabulary, 60), *common]) for _ in range(80)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("width", "options"), [(4, {}), (5, {"group_texts": 8, "small": 6}), (4, {"group_shingles": 1500})])
def test_near_duplicates(spark, width, options):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc_id").withColumn("rep", F.lit(1)).repartition(5)
    got = near_dup.near_duplicates(docs, width=width, **options).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows, width)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs that share exactly 80 of 100 words: none is lost to a signature's chance."""
    rng = np.random.default_rng(9)
    rows = []
    for pair in range(4000):
        words = [f"w{x}" for x in rng.integers(0, 1 << 50, 100)]
        rows += [(2 * pair, " ".join(words[:90])), (2 * pair + 1, " ".join(words[:80] + words[90:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, width=1).where("component_id != id - id % 2").count()
    assert got == 0


def test_large_groups_of_different_texts_are_not_compared_block_by_block(spark, monkeypatch):
    """Texts that have only a long passage in common are one candidate group; their texts go to few tasks, and no link is lost."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(400):
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, 60)]
        if i % 10 == 0 and i:
            own = rows[i - 1][1].split()[80:]
            own[7] = "x"
        rows.append((i, " ".join(passage + own)))
    texts = spark.createDataFrame(rows, "rep long, text string")
    groups = texts.select("rep", F.lit(0).cast("long").alias("component"), F.lit(140 - 3).cast("long").alias("n_shingles"))
    sent, deal = [], near_dup._blocks
    monkeypatch.setattr(near_dup, "_blocks", lambda rows, *options: sent.append(rows.count()) or deal(rows, *options))
    labels, edges = near_dup.confirmed_edges(texts, groups, 4, 80, group_texts=8)
    found = {(r["a"], r["b"]) for r in labels.unionByName(edges).collect() if r["a"] != r["b"]}
    assert found == {(i, j) for i, _, j, kept in brute_components(rows, 4) if not kept} == {(i, i - 1) for i in range(10, 400, 10)}
    assert sum(sent) <= 2 * len(rows)


def test_near_duplicates_odd_ids(spark):
    long = "a b c d e f g h i j k l m n o p"
    rows = [(5, long), (5, long), (7, long), (None, long), (None, None), (8, "other words that stand alone here now"), (9, "x y z q w e r t"), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (None, None, True), (8, 8, True), (9, 5, False), (9, 5, False)], key=str)
    kept = near_dup.keep_one_of_each(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [5, 8, None, None]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_flagged_ids_hold_all_sought(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id - 10000 AS k", "id AS id", "'x' AS bits").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, -1L AS id, 'y' AS bits"))
    ids = spark.range(0, 3000).selectExpr("id * 3 - 5000 AS k")
    sought = {r["k"] for r in ids.collect()}
    for most in (8192, 1):  # a filter of the usual size, and one that overflows
        monkeypatch.setattr(shared, "MOST_BITMAPS", most)
        got = shared.flag_ids(rows, "k", ids).collect()
        assert len(got) == 20_001 and got[0].asDict().keys() == {"k", "id", "bits", "__may"}
        flagged = {r["k"] for r in got if r["__may"]}
        assert sought <= flagged and None not in flagged
        if most > 1:
            assert len(flagged - sought) < 0.1 * 17_000
    assert not any(r["__may"] for r in shared.flag_ids(rows, "k", ids.limit(0)).collect())


def test_one_of_each_keeps_columns_and_one_row_an_id(spark):
    long = "a b c d e f g h i j k l m n o p"
    rows = [(4, "", "m"), (5, long, "n"), (6, long, "o"), (6, "", "p"), (5, long, "q"), (4, None, "r"), (None, long, "s"), (None, long, "s")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n string")
    kept = near_dup.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert [r[0] for r in got] == [4, 5, 6, None, None] and set(got) <= set(rows)
    assert sorted(tuple(r) for r in near_dup.keep_one_of_each(docs.repartition(3)).where("doc_id IS NOT NULL").collect()) == got[:3]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def brute_search(ids, vectors, queries, k):
    out = []
    for q in queries:
        score = sorted(((-int(vectors[j] @ vectors[q]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
        out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return sorted(out)


def test_components_in_one_task_and_by_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 4000, (2500, 2))] + [(i, i + 1) for i in range(5000, 5200)] + [(6000 + i, 6000) for i in range(1200)] + [(None, 1), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    found = []
    for most in (200_000, 0):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        found.append(sorted(map(tuple, components.components(table).collect())))
    assert found[0] == found[1] and len(found[0]) > 3000


def test_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    x = (centers[rng.integers(0, 6, 700)] + 0.1 * rng.normal(size=(700, 8))).astype(np.float32)
    x[100:300] = x[100]  # copies
    rows = [(i, [float(v) for v in x[i]], "r") for i in range(700)]
    odd = [(1000, None, "r"), (1050, [], "r"), (1100, [float("nan")] * 8, "r"), (1150, [None] * 8, "r"), (1200, [1.0] * 3, "r"), (1250, [float("inf")] + [0.0] * 7, "r"), (None, [1.0] * 8, "r")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id string")
    vectors = mtree.integer_vectors(table, "vec_id", "embedding")
    monkeypatch.setattr(mtree, "SLICE", 60)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 5)
    got = sorted(tuple(r) for r in mtree.search(vectors.where("id % 50 = 0"), vectors).select("query_id", "rank", "vec_id", "score").collect())
    whole = np.floor(x.astype(float) * 256)
    assert got == brute_search(list(range(700)), whole, range(0, 700, 50), 5)
    few = vectors.where("id < 3")
    assert len(mtree.search(few.where("id % 50 = 0"), few).collect()) == 2
    assert mtree.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_exact_search_of_large_numbers_and_several_dimensions(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SLICE", 20)
    rng = np.random.default_rng(3)
    for size in (1e7, 1e12, 1e200):
        rows = [(i, [float(x) for x in rng.normal(size=4) * size]) for i in range(150)] + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(150, 220)]
        rows += [(300, [size, 0.0, 0.0, 0.0]), (301, [size, 1.0, 0.0, 0.0]), (302, [-size, 1.0, 0.0, 0.0])]
        vectors = mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        got = sorted(tuple(r) for r in mtree.search(vectors.where("id % 50 = 0"), vectors).select("query_id", "rank", "vec_id", "score").collect())
        want = []
        limit = (1 << 63) - 1
        for dim in (2, 4):
            ids = [i for i, v in rows if len(v) == dim]
            whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
            for q in (i for i in ids if i % 50 == 0):
                score = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(whole[q], whole[j], strict=True)))), j) for j in ids if j != q)[:5]
                want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(score)]
        assert got == sorted(want)


def test_search_tree_grows(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SLICE", 8)
    monkeypatch.setattr(mtree, "NODES", 4)
    monkeypatch.setattr(mtree, "FAN", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6)) + 4 * rng.normal(size=(30, 6))[rng.integers(0, 30, 900)]
    sample = np.floor(256 * x)
    routes = mtree.Routes.choose(sample, 900, mtree.Scale(6, np.abs(sample).max()))
    assert max(len(routes.path(k)) for k in range(len(routes.parent))) >= 4
    vectors = mtree.integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in mtree.search(vectors.where("id % 50 = 0"), vectors).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_search(list(range(900)), sample, range(0, 900, 50), 5)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "mix", "encode"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, seen[-1], sf), f"test-{name}")
        if name != "encode":
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        seen.append(out)
    raw, clean, lines, unique, mixed, ids = ([tuple(r) for r in t.select("doc_id", *(c for c in ("text",) if c in t.columns)).collect()] for t in seen)
    assert set(clean) <= set(raw)
    assert sorted((i, t) for i, _, _, t in brute_lines(clean)) == sorted(lines)
    groups = brute_components(lines, 5)
    assert sorted(i for i, _ in unique) == [i for i, _, _, kept in groups if kept]
    assert set(mixed) <= set(unique) and sorted(i for i, _ in mixed) == sorted(i for (i,) in ids)
    assert seen[-1].where("NOT lossless").count() == 0
    drawn = {}
    for i, x in seen[-1].select("doc_id", "ids").collect():
        drawn.setdefault(i, []).append(tuple(x))
    several = [x for x in drawn.values() if len(x) > 1 and len(x[0]) > 20]
    assert several and all(len(set(x)) == len(x) for x in several)  # copies are segmented by draws of their own
    again = corpus_pipeline.run(spark, sf).select("doc_id", "ids").collect()
    assert sorted(map(str, again)) == sorted(map(str, seen[-1].select("doc_id", "ids").collect()))


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dup", "mix", "encode"])
def test_stages_take_odd_rows(spark, sf, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "some words", "en", None, 3), (2, "", "en", "s", 0), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3)]
    stage = dict(corpus_pipeline.STAGES)[name]
    table = spark.createDataFrame(rows, schema)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    if name == "toxicity":
        table = documents.select(*table.columns).unionByName(table)
    assert stage(spark, table, sf).count() > 0
    assert stage(spark, table.limit(0), sf).count() == 0


def test_numbered_copies(spark):
    schema = "doc_id long, text string, copy string"
    rows = [(1, "a", "x")] * 2500 + [(2, None, "y")] * 3 + [(None, "b", None), (3, "a", "x"), (3, "b", "x")]
    table = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in mixing.numbered_copies(table, many=1000).select("doc_id", "text", "copy").collect()), key=str)
    want = [(1, "a", k + 1) for k in range(2500)] + [(2, None, k + 1) for k in range(3)] + [(None, "b", 1), (3, "a", 1), (3, "b", 1)]
    assert got == sorted(want, key=str) and mixing.numbered_copies(table.limit(0)).count() == 0
    docs = spark.range(500).selectExpr("id AS doc_id", "id % 3 AS source", "concat('t', id) AS text")
    mixed = mixing.mix_sources(docs, default_weight="sqrt(n_rows) * (1 + n_rows % 2)", key_col="doc_id")
    again = mixing.numbered_copies(mixed.drop("copy", "shuffle_key"))
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, mixed.select("doc_id", "copy").collect()))


def test_empty_vectors_meet_each_other(spark):
    rows = [(i, []) for i in (0, 3, 7, 50, 50, 100)] + [(1, [1.0]), (150, [2.0])]
    vectors = mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in mtree.search(vectors.where("id % 50 = 0").distinct(), vectors, 3).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 3, 0), (0, 2, 7, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0), (50, 3, 7, 0), (100, 1, 0, 0), (100, 2, 3, 0), (100, 3, 7, 0), (150, 1, 1, 512 * 256)]


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dup", "mix", "encode"])
def test_stages_take_long_texts_clashing_columns_and_ties(spark, sf, name):
    """Columns with the names that operators use inside are carried with their values; a long text and equal rows go through whole."""
    clash = ["id", "node", "rep", "hub", "n", "key", "seed", "row", "times", "join_key", "__id", "score", "kept"]
    long = "\n".join(f"line number {k} of a long text that goes on and on" for k in range(20_000))
    rows = [(1, long, "en", "s", len(long)), (2, "short words here", "en", "s", 16), (2, "short words here", "en", "s", 16), (5, "x" * 300_000, "fr", "t", 300_000), (6, "Ünï \U0001f600", None, "t", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents = spark.read.parquet(f"{sf}/documents.parquet").select(*table.columns)
    table = (documents.where("doc_id > 10").unionByName(table) if name == "toxicity" else table).selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in clash))
    out = dict(corpus_pipeline.STAGES)[name](spark, table, sf)
    found = out.where("doc_id IN (1, 2, 5, 6)").collect()
    if name == "encode":
        assert sorted(r["doc_id"] for r in found) == [1, 2, 2, 5, 6] and all(r["lossless"] for r in found)
        return
    assert out.columns == table.columns
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        assert r["text"] == texts[r["doc_id"]] and all(r[c] == f"{c}{r['doc_id']}" for c in clash)
    if name != "mix":
        assert sorted(r["doc_id"] for r in found) == ([1, 2, 5, 6] if name == "near_dup" else [1, 2, 2, 5, 6])
