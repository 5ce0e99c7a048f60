"""Language ID, toxicity, language-model scores and SentencePiece: held-out accuracy, brute force, round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loupe.llm import langid, lm_score, pieces, queries, toxicity
from loupe.llm.lattice import Lattice, Vocabulary
from loupe.llm.queries import QUERIES
from loupe.llm.textscan import scans

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet"], "bb": ["kuka", "talo", "yksi", "hyvä", "päivä"], "cc": ["straße", "über", "schön", "zwei", "wald"]}


def language_rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], 12)), lang, "x") for i in range(n) for lang in [("aa", "bb", "cc")[i % 3]]]


def test_language_id(spark):
    schema = "doc_id long, text string, lang string, label string"
    train = spark.createDataFrame([*language_rows(1, 90), (900, None, "aa", ""), (901, "kuka talo", None, "")], schema)
    model = langid.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(500, None, None, None), (501, "", None, None), (502, "12 .. !", None, None), (503, "ж", None, None), (None, "kuka talo yksi", None, None), (504, "über schön " * 30_000, None, None), (504, "über schön " * 30_000, None, None)]
    got = langid.predict(spark.createDataFrame(language_rows(2, 60) + odd, schema), model).collect()
    assert len(got) == 67
    assert all(r["lang_pred"] == ("aa", "bb", "cc")[r["id"] % 3] and 0 <= r["score"] <= 1 for r in got if r["id"] is not None and r["id"] < 60)
    by = {r["id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[503]["lang_pred"] in model.languages
    assert by[None]["lang_pred"] == "bb" and by[504]["lang_pred"] == "cc"
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(train, nothing).collect()} == {"und"}
    alone = langid.fit(train.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in langid.predict(train.where("text IS NOT NULL"), alone).collect()} == {"aa"}
    assert langid.predict(train.limit(0), model).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)


def brute_language(rows, texts):
    """Counts, classifiers and decoding again, one n-gram at a time."""
    fold = lambda t: bytes(c + 32 if 0x41 <= c < 0x5B else 0x20 if c < 0x61 or 0x7B <= c < 0x80 else c for c in t.encode())

    def grams(t):
        data = fold(t)
        for order in (1, 2, 3):
            for i in range(len(data) - order + 1):
                if any(c != 0x20 for c in data[i : i + order]):
                    h = 0x811C9DC5 + order
                    for c in data[i : i + order]:
                        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                    yield (h ^ h >> 15) & (langid.BUCKETS - 1)

    counts = {}
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    languages = sorted(counts)
    total = {x: sum(counts[x].values()) for x in languages}
    code = langid.codewords(len(languages))
    floor = 0.5 / max(1.0, sum(total.values()) / len(languages))
    out = []
    for t in texts:
        loss = dict.fromkeys(languages, 0.0)
        seen = list(grams(t))
        for bit in code.T:
            odds = []
            for g in seen:
                share = [counts[x][g] / total[x] for x in languages]
                odds.append(math.log((np.mean([s for s, b in zip(share, bit, strict=True) if b]) + floor) / (np.mean([s for s, b in zip(share, bit, strict=True) if not b]) + floor)))
            margin = float(np.mean(odds))
            for x, b in zip(languages, bit, strict=True):
                loss[x] += math.log1p(math.exp(-4.0 * margin * (1 if b else -1)))
        p = {x: math.exp(min(loss.values()) - loss[x]) for x in languages}
        best = max(languages, key=lambda x: (p[x], -languages.index(x)))
        out.append((best, p[best] / sum(p.values())))
    return out


def test_language_id_by_brute_force(spark):
    rows = [(t, lang) for _, t, lang, _ in language_rows(4, 45)]
    texts = [t for _, t, _, _ in language_rows(5, 20)] + ["Über-Wald 12 LOREM", "zwei kuka"]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect())
    for (_, lang, score), (want, p) in zip(got, brute_language(rows, texts), strict=True):
        assert lang == want and math.isclose(score, p, rel_tol=1e-4)


def test_language_of_a_long_text(spark, monkeypatch):
    """In pieces a long text has the margins that it has whole; too many labels are refused."""
    model = langid.fit(spark.createDataFrame([(t, lang) for _, t, lang, _ in language_rows(4, 45)], "text string, lang string"))
    scan = next(scans(pa.array(["kuka talo über " * 400])))[2]
    whole = model.margins(scan)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 1000)
    assert np.allclose(whole, model.margins(scan), rtol=1e-5)
    many = spark.range(1100).selectExpr("concat('x', id) AS lang", "'some text' AS text")
    with pytest.raises(ValueError, match="more than 1000"):
        langid.fit(many)


def test_toxicity_gradient(monkeypatch):
    """One step of training goes down the loss as its numeric gradient says."""
    monkeypatch.setattr(toxicity, "_HIDDEN", 0.0)
    monkeypatch.setattr(toxicity, "_STEPS", 1)
    monkeypatch.setattr(toxicity, "_BATCH", 4)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 1 << 17, (9, 4)).astype(np.int32) for _ in range(6)]
    labels = np.array([1, 1, 1, 0, 0, 0])
    draw = np.random.default_rng(5)
    pick = np.concatenate([draw.choice(np.arange(3), 2), draw.choice(np.arange(3, 6), 2)])
    before, after = toxicity.Net.fresh(), toxicity.train(texts, labels)

    def loss(net):
        logit = np.array([net.logits(texts[i], np.zeros(9, int), 1)[0] for i in pick], float)
        return np.mean(np.log1p(np.exp(-logit * np.where(labels[pick] == 1, 1, -1))))

    before.embed, before.filters = before.embed.astype(float), [f.astype(float) for f in before.filters]
    before.bias, before.out = before.bias.astype(float), before.out.astype(float)
    rate = toxicity._RATE + 0.005

    def step_of(g, decay=0.0):  # the first step of Adagrad
        g = g + decay
        return -rate * g / math.sqrt(1e-3 + g * g)

    checked = 0
    places = [("filters", k, i, j) for k in range(3) for i in (0, 7) for j in (0, 3)] + [("bias", None, 2, None), ("out", None, 5, None), ("embed", None, int(texts[pick[0]][4, 0]), 3)]
    for name, k, i, j in places:
        old, new = (getattr(x, name) if k is None else getattr(x, name)[k] for x in (before, after))
        at = i if j is None else (i, j)
        eps, start = 3e-3, float(old[at])
        old[at] = start + eps
        up = loss(before)
        old[at] = start - eps
        down = loss(before)
        old[at] = start
        g = (up - down) / (2 * eps)
        decay = 1e-4 * start if name in ("filters", "out") else 0.0
        assert math.isclose(float(new[at]) - start, step_of(g, decay), rel_tol=3e-2, abs_tol=5e-5), (name, k, i, j)
        checked += g != 0
    assert checked >= 5


def test_toxicity_held_out(spark):
    """At sf0.01: most toxic held-out texts are found, clean ones are left alone."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(toxic) == 14 and sum(toxic) >= 8 and len(clean) == 80 and sum(clean) <= 2


def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    calm = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = list(rng.choice(calm, 60))
        if i % 4 == 0:
            for p in rng.integers(0, 60, 3):
                words[p] = rng.choice(["vileone", "vileness", "vilest"])
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", i % 4 == 0))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(400, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows] + [(7, None), (9999, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fresh = toxic_rows(80, 2)
    odd = [(900, None, None), (901, "", "en"), (None, "calm word1", "xx"), (902, "word5 " * 40_000 + "vileone vilest vileness", "en"), (902, "word5 " * 40_000 + "vileone vilest vileness", "en")]
    table = spark.createDataFrame([r[:3] for r in fresh] + odd, "doc_id long, text string, lang string")
    got = toxicity.score(table, model).select("row.doc_id", "score", "rejected").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 85 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(by[r[0]]["score"] >= 0.3) == r[3] for r in fresh]) > 0.95
    assert by[902]["score"] >= 0.3 and by[900]["score"] == by[901]["score"] < 0.3
    kept = toxicity.drop_toxic(table.withColumn("row", F.lit(1)), model)
    assert kept.columns == [*table.columns, "row"] and kept.count() == sum(not r["rejected"] for r in got)
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r[0] for r in toxicity.score(docs, one_class).select("score").collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_toxicity_learns_long_tailed_words():
    """120 telling words, each in 2 to 3 % of the toxic texts and under 0.5 % of all."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(1620)]
    calm, vile = words[:1500], words[1500:]

    def sample(n, every):
        texts = []
        for i in range(n):
            text = list(rng.choice(calm, 60))
            if i % every == 0:
                for p in rng.choice(60, 3, False):
                    text[p] = rng.choice(vile)
            texts.append(" ".join(text))
        pairs, owner = toxicity.word_buckets(next(scans(pa.array(texts)))[2])
        return np.split(pairs, np.searchsorted(owner, np.arange(1, n))), np.arange(n) % every == 0

    texts, toxic = sample(2400, 8)
    net = toxicity.train(texts, toxic.astype(int))
    net.shift += math.log(1 / 7)
    texts, toxic = sample(800, 2)
    found = np.array([net.score(t, np.zeros(len(t), int), 1)[0] for t in texts]) >= toxicity.DEFAULT_THRESHOLD
    assert found[toxic].mean() > 0.6 and found[~toxic].mean() < 0.03


def enumerate_segmentations(word, scores, v, index):
    """All (pieces, score) of a word; a character without a piece is its bytes' pieces."""
    if not word:
        return [((), 0.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in index:
            first = (index[word[:k]],)
        elif k == 1:
            first = tuple(v.byte_ids[b] for b in word[0].encode())
        else:
            continue
        out += [((*first, *s), x + scores[list(first)].sum()) for s, x in enumerate_segmentations(word[k:], scores, v, index)]
    return out


def usable_pieces(v):
    return {p: i for i, p in enumerate(v.pieces) if not p.startswith("<") and "\u2581" not in p.lstrip("\u2581")}


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


def test_lattice_sums_all_segmentations(vocabulary):
    v = vocabulary
    index = usable_pieces(v)
    assert math.isclose(np.exp(v.scores).sum(), 1, rel_tol=1e-9)
    words = ["▁hello", "▁", "x", "▁the", "abcdefgh", "▁naïve", "▁a\u2c00ꙮb", "\U0001d4b3"]
    lattice = Lattice(words, v)
    alpha = lattice.forward(v.scores)[lattice.final]
    for w, a in zip(words, alpha, strict=True):
        assert math.isclose(a, np.logaddexp.reduce([x for _, x in enumerate_segmentations(w, v.scores, v, index)]), rel_tol=1e-12)
    times = {"▁hello": 2, "abcdefgh": 1, "▁a\u2c00ꙮb": 3}
    expected = lattice.expected(v.scores, np.array([times.get(w, 0) for w in words], float))
    want = Counter()
    for w, n in times.items():
        found = enumerate_segmentations(w, v.scores, v, index)
        total = np.logaddexp.reduce([x for _, x in found])
        for s, x in found:
            for p in s:
                want[p] += n * math.exp(x - total)
    assert all(math.isclose(expected[i], n, rel_tol=1e-9) for i, n in want.items()) and math.isclose(expected.sum(), sum(want.values()))


def test_sampling_follows_the_lattice(vocabulary):
    v = vocabulary
    ids = pieces.encode_texts(["hello"] * 20_000, np.arange(20_000, dtype=np.uint64), v)
    seen = Counter(tuple(x.tolist()) for x in ids)
    found = enumerate_segmentations("▁hello", v.scores, v, usable_pieces(v))
    total = np.logaddexp.reduce([x for _, x in found])
    for s, x in found:
        p = math.exp(x - total)
        assert abs(seen[tuple(map(int, s))] / 20_000 - p) < 5 * math.sqrt(p / 20_000) + 1e-3


def test_a_sample_does_not_depend_on_its_batch(vocabulary):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(30)) for _ in range(200)]
    seeds = np.arange(200, dtype=np.uint64)
    together = pieces.encode_texts(texts, seeds, vocabulary)
    assert all((pieces.encode_texts([t], seeds[i : i + 1], vocabulary)[0] == together[i]).all() for i, t in enumerate(texts))


def test_round_trip(spark):
    texts = [None, "", " ", "  two  spaces ", "\n\n", "▁ literal ▁▁ mark", "日本語 𝒳 \x00 \t\r", "x" * 20_000, "word " * 30_000, "ordinary text, with punctuation."]
    rows = [(i, t, "r") for i, t in enumerate(texts)] + [(None, "null key", "r"), (9, texts[9], "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = pieces.encode(docs)
    assert all(r["lossless"] for r in got.collect()) and got.count() == 12
    back = pieces.decode(got.select("row.doc_id", "ids"))
    assert sorted(map(str, (tuple(r) for r in back.select("doc_id", "text").collect()))) == sorted(str((i, t)) for i, t, _ in rows)
    again = pieces.encode(docs.repartition(5))
    key = lambda r: (str(r["row"]["doc_id"]), str(r["ids"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, again.collect()))
    assert pieces.encode(docs.limit(0)).count() == 0
    other = pieces.encode(docs.where("doc_id = 8"), seed=2).first()["ids"]
    assert other != got.where("row.doc_id = 8").first()["ids"]


@pytest.mark.parametrize("adapt", [True, False])
def test_lm_scores(spark, vocabulary, adapt):
    texts = ["the cat sat", "The dog SAT on the mat", None, "", "unseen words here ▁ 日本", "the the the", "rep " * 20_000, "the cat sat", "ꙮ x\u2c00y ▁ über"]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(None, "null id", 0), (0, "the cat sat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    split = [(lower(t).split(), i is not None and i != 4) for i, t, _ in rows]
    count = Counter(w for words, train in split if train for w in words)
    n_texts = sum(train for _, train in split)
    n, v = sum(count.values()) + n_texts, len(count) + 1
    results = [lm_score.score(docs, "doc_id <> 4", hot=hot, adapt=adapt).collect() for hot in (1 << 19, 2)]
    for got in results:
        assert len(got) == len(rows)
        left = sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
        base = lambda words: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_texts + 1) / (n + v + 1))
        assert left == sorted((str(i), len(words) + 1, sum(count[w] > 0 for w in words) + 1, n, round(base(words), 6)) for (i, _, _), (words, _) in zip(rows, split, strict=True))
    a, b = ({(str(r["id"]), r["n_tokens"]): r["score"] for r in got} for got in results)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    # the model's score by brute force: expected piece uses over training words, then all segmentations
    index = usable_pieces(vocabulary)
    marked = lambda w: "▁" + w.replace("▁", "\ud800")

    def segmentations(w, scores):
        found = enumerate_segmentations(marked(w).replace("\ud800", "\u2581") if w == "▁" else marked(w), scores, vocabulary, index)
        return found if w != "▁" else [(s, x) for s, x in enumerate_literal(scores)]

    def enumerate_literal(scores):
        own = [index["▁"], *(vocabulary.byte_ids[b] for b in "▁".encode())]
        return [(tuple(own), scores[own].sum())]

    prior = np.exp(vocabulary.scores)
    if adapt:
        uses = np.zeros(vocabulary.n)
        for w, c in count.items():
            found = segmentations(w, vocabulary.scores)
            total = np.logaddexp.reduce([x for _, x in found])
            for s, x in found:
                np.add.at(uses, list(s), c * math.exp(x - total))
        weight = uses + vocabulary.n * prior
    else:
        weight = prior * (sum(count.values()) + vocabulary.n)
    total = weight.sum() + n_texts + 1
    with np.errstate(divide="ignore"):
        scores = np.log(weight / total)
    assert math.isclose(np.exp(scores).sum() + (n_texts + 1) / total, 1, rel_tol=1e-9)
    for key, words in ((("0", 4), ("the", "cat", "sat")), (("8", 5), ("ꙮ", "x\u2c00y", "▁", "über")), (("4", 6), ("unseen", "words", "here", "▁", "日本"))):
        want = sum(np.logaddexp.reduce([x for _, x in segmentations(w, scores)]) for w in words)
        assert math.isclose(a[key], (want + math.log((n_texts + 1) / total)) / math.log(10), rel_tol=1e-9)
    assert lm_score.score(docs.limit(0), "true").count() == 0
    assert lm_score.score(docs, "false").where("n_known > 0").count() == 0


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61ff62') AS string) AS text UNION ALL SELECT 2L, 'ab'")
    assert lm_score.score(docs, "true").count() == 2
    assert [r["lossless"] for r in pieces.encode(docs).collect()] == [True, True]


def test_fold_is_crc32(spark, sf):
    rows = QUERIES["op5_toxicity"](spark, sf).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_toxicity_forward_pass_by_loops():
    """Convolution and max pooling recomputed one word, one filter at a time."""
    rng = np.random.default_rng(8)
    net = toxicity.Net.fresh(3)
    net.bias = rng.normal(size=len(net.bias)).astype(np.float32)
    owner = np.repeat([0, 1, 3, 4], [1, 2, 7, 12])  # text 2 has no words
    words = rng.integers(0, len(net.embed), (len(owner), 2))
    got = net.logits(words, owner, 5)
    dim = net.embed.shape[1]
    for text in range(5):
        vectors = [sum(net.embed[b].astype(float) for b in w) for w in words[owner == text]]
        feats = []
        for width, filters in zip(toxicity._WIDTHS, net.filters, strict=True):
            for f in filters.T:
                sums = [sum(float(vectors[at + j] @ f[j * dim : (j + 1) * dim]) for j in range(width) if at + j < len(vectors)) for at in range(len(vectors))]
                feats.append(max(sums, default=0.0))
        want = float(np.maximum(np.array(feats) + net.bias, 0) @ net.out) + net.shift
        assert got[text] == pytest.approx(want, abs=1e-4)


def test_thresholds_are_those_of_the_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = queries.fit_toxicity(spark, docs, sf)
    rows = toxicity.score(docs.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))), model).select("row.lang", "score", "threshold", "rejected").collect()
    for r in rows:
        assert r["threshold"] == pytest.approx(model.thresholds.get(r["lang"], toxicity.DEFAULT_THRESHOLD))
        assert r["rejected"] == (r["score"] >= r["threshold"])
    assert {r["threshold"] for r in rows if r["lang"] == "xx"} == {toxicity.DEFAULT_THRESHOLD}


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """A sample of each class, or one of texts under some length, would miss words that few texts hold; copies of the net are merged alike whatever the partitions."""
    monkeypatch.setattr(toxicity, "_COPY_TEXTS", 2000)
    rows = []
    for i in range(6000):
        words = [f"calm{(i * 31 + 7 * k) % 400}" for k in range(20)]
        if i % 2:
            words[i % 20] = "vileone"
        rows.append((i, " ".join(words), "en", i % 2))
    late = [(10_000 + i, f"{'calm1 calm2 ' * 1500} gruesome calm{i % 400}", "fr", 1) for i in range(60)]  # more than 2,000 words each
    late += [(20_000 + i, f"{'calm1 calm2 ' * 1500} calm{i % 400}", "fr", 0) for i in range(60)]
    table = spark.createDataFrame(rows + late, "doc_id long, text string, lang string, toxic int")
    docs, labels = table.drop("toxic"), table.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id >= 10000"), model).select("row.doc_id", "score").collect()}
    assert np.mean([(got[i] >= 0.3) == (t == 1) for i, _, _, t in late]) > 0.9
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.net.flat(), again.net.flat()) and model.thresholds == again.thresholds


def test_toxicity_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Net.fresh(3)
    owner = np.repeat([0, 1, 3], [5, 40, 3])
    words = rng.integers(0, len(net.embed), (len(owner), 4))
    whole = net.features(words, owner, 4)
    monkeypatch.setattr(toxicity, "_SLICE_WORDS", 4)
    sliced = net.features(words, owner, 4)
    assert np.allclose(whole[0], sliced[0], atol=1e-6) and np.array_equal(whole[1], sliced[1])
