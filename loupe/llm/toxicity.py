"""Convolutional toxicity classifier, trained in numpy.

Words (letters, digits and non-ASCII bytes, A-Z lower-cased) get the sum of hashed
embeddings of the word and its prefixes; filters of several widths slide over the whole text, are max-pooled and
feed a logistic output.  Max pooling lets a few words decide a long text, and its
gradient touches only the winning positions, so training is cheap.

The classifier is fitted on every labelled text, whole, in a few rounds.  In a round tasks train copies of the net, each
on some thousands of texts (dealt by their ids' hashes), and the next round starts from the copies' mean: an
embedding's is taken over the copies that changed it, so rare words aren't thinned out.  A copy's batches are half and half and run through all its texts, the
smaller class more than once; the output is corrected for the classes' true ratio, counted over all labels.  Changes are summed as whole numbers, so
the result doesn't hang on the order of tasks.  Of several rows with one id the text with the smallest hash is read.
A threshold per language is the cut of best F1 over all fitted texts, by scores counted in steps of 1/4096.  Scoring reads every word of every text;
language never enters a score.

Null and empty texts have no words and get the score of the filters' bias, as a text
without any signal.  Labels that are null or have no text are ignored; of several
labels of one id the largest counts.  A very long text is scored whole, alone in its chunk, and
fitted whole.  Other columns, whatever their names, are carried in ``row`` or by
``drop_toxic``; an empty table gives an empty one.  Without labels of both classes every score is the
share of label 1 (0 if there are none).  Repeated rows give equal rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import flag_ids, scratch, stored
from .textscan import ALNUM, SMALL_BYTES, Scan, mix, scans

#: Rounds of training, and texts that one copy of the net learns from in each, about.
_ROUNDS, _COPY_TEXTS = 2, 4096
#: A copy has at least so many texts of each class, about.
_COPY_LEAST = 64
#: Words that a copy holds at once, and words of one batch (at least one text of each class).
_CHUNK_WORDS, _BATCH_WORDS = 1 << 21, 1 << 18
#: Words whose filters are computed at once.
_SLICE_WORDS = 1 << 14
#: Changes of weights are summed as multiples of 1/_UNIT, scores are counted in steps of 1/_STEPS_OF_SCORE.
_UNIT, _STEPS_OF_SCORE = 1 << 22, 4096
_BUCKET_BITS = 17
#: A word's embedding is the sum of those of the word and of its first so many bytes.
_PREFIXES = (4, 6, 8)
_DIM, _WIDTHS, _FILTERS = 12, (1, 2, 3), 8
_STEPS, _BATCH, _RATE = 800, 32, 0.06
#: Each word of a batch is hidden with this chance. No word is too rare to learn from.
_HIDDEN = 0.4
DEFAULT_THRESHOLD = 0.3


def word_buckets(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word and its prefixes, and the words' texts."""
    low = scan.lowered()
    s, e, owner = low.spans(ALNUM)
    parts = [low.hashes(s, e), *(low.hashes(s, np.minimum(s + k, e)) + np.uint64(k) for k in _PREFIXES)]
    mask = np.uint64((1 << _BUCKET_BITS) - 1)
    return np.stack([(mix(h) & mask).astype(np.int32) for h in parts], 1), owner


@dataclasses.dataclass
class Net:
    embed: np.ndarray  # a row for each bucket; the last more is padding
    filters: list[np.ndarray]  # per width: width * dim x filters
    bias: np.ndarray  # all filters
    out: np.ndarray
    shift: float = 0.0
    prior: float | None = None  # the answer of an untrained net

    @classmethod
    def fresh(cls, seed: int = 11) -> Net:
        rng = np.random.default_rng(seed)
        n = len(_WIDTHS) * _FILTERS
        embed = rng.normal(0, 0.02, ((1 << _BUCKET_BITS) + 1, _DIM)).astype(np.float32)
        embed[-1] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * _DIM), (w * _DIM, _FILTERS)).astype(np.float32) for w in _WIDTHS]
        return cls(embed, filters, np.full(n, 0.05, np.float32), rng.normal(0, 0.3, n).astype(np.float32))

    def copy(self) -> Net:
        return Net(self.embed.copy(), [f.copy() for f in self.filters], self.bias.copy(), self.out.copy(), self.shift)

    def flat(self) -> np.ndarray:
        """All weights in rows of _DIM: the embeddings, and then the others one after another, filled up with zeros."""
        rest = np.concatenate([*(f.ravel() for f in self.filters), self.bias, self.out, [self.shift]])
        return np.concatenate([self.embed, np.append(rest, np.zeros(-len(rest) % _DIM)).reshape(-1, _DIM)]).astype(np.float32)

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Net:
        net = cls.fresh()
        rest, at = flat[len(net.embed) :].ravel(), 0
        net.embed = flat[: len(net.embed)].astype(np.float32)
        for v in (*net.filters, net.bias, net.out):
            v[...] = rest[at : at + v.size].reshape(v.shape)
            at += v.size
        net.shift = float(rest[at])
        return net

    def vectors(self, words: np.ndarray) -> np.ndarray:
        total = self.embed[words[:, 0]]
        for part in words.T[1:]:
            total += self.embed[part]
        return total

    def features(self, words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pooled features of n texts, and for each the winning first word (-1: none, the filter saw only padding)."""
        pooled = np.full((n, len(self.bias)), -np.inf, np.float32)
        winner = np.full((n, len(self.bias)), -1)
        ahead = max(_WIDTHS) - 1
        for lo in range(0, len(owner), _SLICE_WORDS):
            hi = min(lo + _SLICE_WORDS, len(owner))
            mine, x = owner[lo:hi], self.vectors(words[lo : hi + ahead])
            texts, starts = np.unique(mine, return_index=True)
            places = np.searchsorted(texts, mine)
            for k, (width, f) in enumerate(zip(_WIDTHS, self.filters, strict=True)):
                part = slice(k * _FILTERS, (k + 1) * _FILTERS)
                score = x[: hi - lo] @ f[:_DIM]
                for j in range(1, width):
                    inside = np.flatnonzero(owner[lo : min(hi, len(owner) - j)] == owner[lo + j : hi + j])
                    score[inside] += x[inside + j] @ f[j * _DIM : (j + 1) * _DIM]
                top = np.maximum.reduceat(score, starts, axis=0)
                better = top > pooled[texts, part]
                hit, col = np.nonzero((score == top[places]) & better[places])
                winner[mine[hit[::-1]], k * _FILTERS + col[::-1]] = lo + hit[::-1]
                pooled[texts, part] = np.maximum(pooled[texts, part], top)
        pooled[np.isneginf(pooled)] = 0  # no words
        return np.maximum(pooled + self.bias, 0), winner

    def logits(self, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.features(words, owner, n)[0] @ self.out + self.shift

    def score(self, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        if self.prior is not None:
            return np.full(n, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(words, owner, n).astype(np.float64), -500, 500)))


def _drawn(labels: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    yes, no = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    for _ in range(_STEPS):
        yield np.concatenate([rng.choice(yes, _BATCH // 2), rng.choice(no, _BATCH // 2)])


def _in_turn(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, visits: float) -> Iterator[np.ndarray]:
    """Batches of both classes in which every text comes, those of the larger class ``visits`` times at least."""
    classes = [c for c in (np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)) if len(c)]
    half = max(1, min(_BATCH // 2, _BATCH_WORDS // max(1, 2 * max(map(len, texts)))))
    steps = math.ceil(max(1.0, visits) * max(map(len, classes)) / half)
    turns = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * half // len(c)))]) for c in classes]
    for step in range(steps):
        yield np.concatenate([t[step * half : (step + 1) * half] for t in turns])


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 5, *, net: Net | None = None, picks: list[np.ndarray] | None = None, done: float = 0.0, ends: float = 1.0) -> Net:
    """Adagrad over class-balanced batches; texts are arrays of word buckets.

    ``net`` is changed in place; ``picks`` are the batches, by default drawn; ``done`` and ``ends``: what share of the training came before, and what share ends with this.
    """
    net, rng = net or Net.fresh(), np.random.default_rng(seed)
    picks = _drawn(labels, rng) if picks is None else picks
    n_steps = len(picks) if isinstance(picks, list) else _STEPS
    past = [np.full_like(v, 1e-3) for v in (net.embed, *net.filters, net.bias, net.out)]
    past_shift = 1e-3
    for step, pick in enumerate(picks):
        rate = _RATE * (1 - done - (ends - done) * step / n_steps) + 0.005
        words = np.concatenate([texts[i] for i in pick])
        owner = np.repeat(np.arange(len(pick)), [len(texts[i]) for i in pick])
        words = np.where((rng.random(len(words)) < _HIDDEN)[:, None], np.int32(len(net.embed) - 1), words)
        feats, winner = net.features(words, owner, len(pick))
        p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.shift, -30, 30)))
        d = ((p - labels[pick]) / len(pick)).astype(np.float32)
        d_out = feats.T @ d + 1e-4 * net.out
        d_feat = (d[:, None] * net.out) * (feats > 0)
        d_bias = d_feat.sum(0)
        steps = [d_bias, d_out]
        row, col = np.nonzero((winner >= 0) & (d_feat != 0))
        at, flow = winner[row, col], d_feat[row, col]
        touched, grads, d_filters = [], [], [np.zeros_like(f) for f in net.filters]
        for k, width in enumerate(_WIDTHS):
            mine = (col >= k * _FILTERS) & (col < (k + 1) * _FILTERS)
            a, c, g, r = at[mine], col[mine] - k * _FILTERS, flow[mine], row[mine]
            for j in range(width):
                ok = (a + j < len(owner)) & (owner[np.minimum(a + j, len(owner) - 1)] == r)
                pos, part = words[a[ok] + j], net.filters[k][j * _DIM : (j + 1) * _DIM]
                np.add.at(d_filters[k][j * _DIM : (j + 1) * _DIM].T, c[ok], net.vectors(pos) * g[ok, None])
                touched += list(pos.T)
                grads += [part[:, c[ok]].T * g[ok, None]] * pos.shape[1]
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True) if touched else (np.zeros(0, int), np.zeros(0, int))
        total = np.zeros((len(rows), _DIM), np.float32)
        if len(rows):
            np.add.at(total, inverse, np.concatenate(grads))
        past[0][rows] += total**2
        net.embed[rows] -= rate * total / np.sqrt(past[0][rows])
        net.embed[-1] = 0
        for k, g in enumerate(d_filters):
            g += 1e-4 * net.filters[k]
            past[1 + k] += g**2
            net.filters[k] -= rate * g / np.sqrt(past[1 + k])
        for v, h, g in zip((net.bias, net.out), past[-2:], steps, strict=True):
            h += g**2
            v -= rate * g / np.sqrt(h)
        g = float(d.sum())
        past_shift += g * g
        net.shift -= rate * g / past_shift**0.5
    return net


@dataclasses.dataclass
class Model:
    net: Net
    thresholds: dict[str, float]

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, DEFAULT_THRESHOLD)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """copy, label and word buckets of each row (copy, label, text)."""
    for batch in batches:
        copy, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, _, scan in scans(batch.column(2), SMALL_BYTES):
            pairs, owner = word_buckets(scan)
            cuts = np.searchsorted(owner, np.arange(scan.n + 1))
            for i in range(scan.n):
                yield int(copy[lo + i]), int(label[lo + i]), pairs[cuts[i] : cuts[i + 1]].copy()


def _chunks(rows: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """copy, texts and labels: all that a copy learns from, in as many pieces as memory asks for."""
    now, texts, labels, held = None, [], [], 0
    for copy, label, words in rows:
        if texts and (copy != now or held + len(words) > _CHUNK_WORDS):
            yield now, texts, np.array(labels)
            texts, labels, held = [], [], 0
        now, held = copy, held + len(words)
        texts.append(words)
        labels.append(label)
    if texts:
        yield now, texts, np.array(labels)


_CHANGE = "spot int, " + ", ".join(f"d{i} long" for i in range(_DIM))


def _trained(handle, round_: int, visits: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each copy of the net changes: rows of ``flat`` weights, as whole numbers."""

    def change(net: Net) -> pa.RecordBatch:
        moved = np.round((net.flat() - handle.value.flat()) * np.float32(_UNIT)).astype(np.int64)
        spots = np.flatnonzero(moved.any(1) | (np.arange(len(moved)) >= len(net.embed)))
        return pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int32)), *(pa.array(moved[spots, i]) for i in range(_DIM))], names=[x.split()[0] for x in _CHANGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, piece = None, None, 0
        for copy, texts, labels in _chunks(_labelled(batches)):
            if copy != now:
                if net is not None:
                    yield change(net)
                now, net, piece = copy, handle.value.copy(), 0
            rng = np.random.default_rng([5, round_, copy, piece])
            picks = list(_in_turn(texts, labels, rng, visits))
            train(texts, labels, int(rng.integers(1 << 30)), net=net, picks=picks, done=round_ / _ROUNDS, ends=(round_ + 1) / _ROUNDS)
            piece += 1
        if net is not None:
            yield change(net)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """Fits on all labelled rows with a text; see the module's text."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    rate = one.agg(F.avg("label")).first()[0]
    if rate is None:
        return Model(dataclasses.replace(Net.fresh(), prior=0.0), {})
    with scratch():
        texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        held = flag_ids(texts, "key", one.select("key")).where("__may").join(one, "key")
        held = held.groupBy("key", "label").agg(F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("text"), "lang")).alias("r"))
        rows = stored(held.select(F.xxhash64(F.lit("toxicity"), "key").alias("place"), "label", "r.lang", "r.text"), "labelled")
        n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return Model(dataclasses.replace(Net.fresh(), prior=float(rate)), {})
        net = _fit_net(rows, n)
        net.shift += float(np.log(rate / (1 - rate)))  # batches are half and half
        return Model(net, _thresholds(rows, net))


def _fit_net(rows: DataFrame, n: dict[int, int]) -> Net:
    spark = rows.sparkSession
    copies = max(1, min(sum(n.values()) // _COPY_TEXTS, min(n.values()) // _COPY_LEAST))
    visits = _STEPS * (_BATCH // 2) / _ROUNDS / (max(n.values()) / copies)  # small tables are gone through more often
    dealt = rows.select(F.pmod("place", F.lit(copies)).cast("int").alias("copy"), "label", "text", "place")
    net = Net.fresh()
    for round_ in range(_ROUNDS):
        handle = spark.sparkContext.broadcast(net)
        ordered = dealt.repartition(copies, "copy").sortWithinPartitions("copy", "place", "label", F.xxhash64("text")).drop("place")
        changes = ordered.mapInArrow(_trained(handle, round_, visits), _CHANGE)
        mean = [(F.sum(f"d{i}") / F.count("*") / _UNIT).cast("float").alias(f"d{i}") for i in range(_DIM)]
        moved = changes.groupBy("spot").agg(*mean).toArrow()  # a row a weight row of the net at most
        flat = net.flat()
        flat[moved["spot"].to_numpy()] += np.stack([moved[f"d{i}"].to_numpy() for i in range(_DIM)], 1)
        net = Net.of_flat(flat)
        handle.destroy()
    return net


def _thresholds(rows: DataFrame, net: Net) -> dict[str, float]:
    """The cut of best F1 for each language in which at least 5 toxic texts are found (fewer say nothing); where it is vague, the middle of the gap."""
    handle = rows.sparkSession.sparkContext.broadcast(Model(net, {}))
    scored = rows.select(F.struct("label").alias("row"), "text", "lang").mapInArrow(_apply(handle, carry=True), "row struct<label int>, score double, threshold double, lang string")
    step = F.floor(F.col("score") * _STEPS_OF_SCORE).alias("step")
    label = F.col("row.label").cast("long")
    counts = scored.where("lang <> ''").groupBy("lang", step).agg(F.count("*").alias("n"), F.sum(label).alias("hits"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum(F.when(F.col("score") >= DEFAULT_THRESHOLD, label).otherwise(0)).alias("found"))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    upto, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang")
    f1 = 2 * F.sum("hits").over(upto) / (F.sum("n").over(upto) + F.sum("hits").over(whole))
    cuts = counts.select("lang", "step", "found", f1.alias("f1"), ((F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2).alias("cut"))
    best = cuts.groupBy("lang").agg(F.max_by("cut", F.struct("f1", "step")).alias("cut"), F.sum("found").alias("found")).where("found >= 5")
    return {r["lang"]: min(max(r["cut"], DEFAULT_THRESHOLD), 0.9) for r in best.collect()}  # a row a language


def _apply(handle, *, carry: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, scan in scans(batch.column(1), SMALL_BYTES):
                words, owner = word_buckets(scan)
                score[lo:hi] = model.net.score(words, owner, scan.n)
            cut = [model.threshold(x) for x in batch.column(2).to_pylist()]
            out = {"row": batch.column(0), "score": pa.array(score), "threshold": pa.array(cut, pa.float64())} | ({"lang": batch.column(2)} if carry else {})
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """row (a struct of docs' columns but the text), score, threshold and rejected of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    scored = rows.mapInArrow(_apply(handle), f"row {rows.schema['row'].dataType.simpleString()}, score double, threshold double")
    return scored.withColumn("rejected", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that aren't rejected, all columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # the input's own names may clash
    packed = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("all"))
    kept = score(packed, model).where(~F.col("rejected"))
    return kept.select(*(F.col(f"row.all.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)))
