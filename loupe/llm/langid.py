"""Language ID with error-correcting output codes.

Each language gets a codeword; for each bit a binary classifier of hashed byte n-grams
separates the languages with that bit set from the others.  The classifiers' log-odds
come from n-gram counts of all training texts, aggregated by Spark, so the model is
one bounded table (languages x buckets) however many texts there are.  A text's
margins are decoded with logistic loss weights: the codeword of least loss wins, the
softmax over losses is its score, and a small lead over the runner-up flags the text
as ambiguous.

Null texts and texts without a letter are ``und`` with score 0 and aren't ambiguous;
letters the model has never seen still get the nearest codeword.  Rows with a null
label train nothing; equal losses go to the first language in sorted order; with no
training rows every text is ``und``.  Repeated rows give equal rows, other columns are
ignored.  A very long text is scored whole, in pieces of bounded size.  An empty table gives an
empty one.  More than MAX_LANGUAGES different labels are an error: the model would have
a row for each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import CHUNK_BYTES, LOWER, Scan, scans

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
_SMOOTH = 0.5
_SHARPNESS = 4.0
AMBIGUOUS_LEAD = 0.2
UNDETERMINED = "und"
MAX_LANGUAGES = 1000

_FOLD = LOWER.copy()
_FOLD[:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0x20


def gram_buckets(scan: Scan, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; BUCKETS where it crosses texts or has no letter."""
    data = _FOLD[scan.data].astype(np.uint32)
    out = np.full(len(data), BUCKETS, np.int32)
    n = len(data) - order + 1
    if n <= 0:
        return out
    h = np.full(n, 0x811C9DC5 + order, np.uint32)
    letter = np.zeros(n, bool)
    for k in range(order):
        h = (h ^ data[k : k + n]) * np.uint32(0x01000193)
        letter |= data[k : k + n] != 0x20
    h ^= h >> np.uint32(15)
    out[:n] = np.where(letter, (h & np.uint32(BUCKETS - 1)).astype(np.int32), BUCKETS)
    for k in range(1, order):
        at = scan.bounds[1:] - k
        out[at[at >= 0]] = BUCKETS
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for lo, hi, scan in scans(batch.column(1)):
            which = {label: k for k, label in enumerate(dict.fromkeys(labels[lo:hi]))}
            row = np.array([which[x] for x in labels[lo:hi]])[scan.text_of(np.arange(len(scan.data)))] if len(scan.data) else np.zeros(0, int)
            total = np.zeros((len(which), BUCKETS + 1), np.int64)
            for order in ORDERS:
                total += np.bincount(row * (BUCKETS + 1) + gram_buckets(scan, order), minlength=total.size).reshape(total.shape)
            for label, k in which.items():
                counts[label] = counts.get(label, 0) + total[k, :BUCKETS]
    for label, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["label", "bucket", "n"])


def codewords(n: int) -> np.ndarray:
    """n codewords of bits: all splits up to 6 languages, else the best of some seeded random codes."""
    if n <= 1:
        return np.zeros((n, 0), bool)
    if n <= 6:
        columns = [c for c in itertools.product((False, True), repeat=n) if not c[0] and any(c)]
        return np.array(columns, bool).T
    rng, best, best_gap = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.random((n, max(15, 10 * int(np.ceil(np.log2(n)))))) < 0.5
        code = code[:, code.any(0) & ~code.all(0)]
        signs = np.where(code, 1.0, -1.0)
        agree = signs @ signs.T  # bits minus twice the differing ones
        np.fill_diagonal(agree, -np.inf)
        gap = int((code.shape[1] - agree.max()) // 2)
        if gap > best_gap:
            best, best_gap = code, gap
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # languages weigh alike
        bits = []
        for bit in self.code.T:
            yes, no = share[bit].mean(0), share[~bit].mean(0)
            floor = _SMOOTH / max(1.0, counts.sum() / len(languages))
            bits.append(np.log((yes + floor) / (no + floor)))
        self.weights = np.zeros((BUCKETS + 1, len(bits)), np.float32)
        if bits:
            self.weights[:BUCKETS] = np.array(bits, np.float32).T

    def margins(self, scan: Scan) -> np.ndarray:
        """Each text's mean log-odds of an n-gram for every bit, over all n-grams of the whole text."""
        if scan.n == 1 and len(scan.data) > CHUNK_BYTES:
            return self._long_margins(scan)
        total, n = np.zeros((scan.n, self.code.shape[1])), np.zeros(scan.n)
        full = np.flatnonzero(np.diff(scan.bounds) > 0)
        if not len(full):
            return total
        starts = scan.bounds[:-1][full]
        for order in ORDERS:
            buckets = gram_buckets(scan, order)
            total[full] += np.add.reduceat(self.weights[buckets], starts, axis=0, dtype=np.float64)
            n[full] += np.add.reduceat((buckets < BUCKETS).astype(np.int64), starts)
        return total / np.maximum(n, 1)[:, None]

    def _long_margins(self, scan: Scan) -> np.ndarray:
        """The same for one long text, from its number of n-grams in each bucket."""
        counts = np.zeros(BUCKETS + 1, np.int64)
        for order in ORDERS:
            for lo in range(0, len(scan.data), CHUNK_BYTES):
                data = scan.data[lo : lo + CHUNK_BYTES + order - 1]  # n-grams that start in the chunk
                counts += np.bincount(gram_buckets(Scan(data, np.array([0, len(data)])), order)[:CHUNK_BYTES], minlength=BUCKETS + 1)
        counts = counts[:BUCKETS]
        return (counts @ self.weights[:BUCKETS].astype(np.float64) / max(1, counts.sum()))[None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, score and lead of each text's nearest codeword."""
        signs = np.where(self.code, 1.0, -1.0)
        loss = np.logaddexp(0, -_SHARPNESS * margins[:, None, :] * signs[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        rest = p.copy()
        rest[np.arange(len(p)), best] = -1.0
        second = rest.max(1) if p.shape[1] > 1 else np.zeros(len(p))
        return best, score, score - second


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model:
    """Learns from every row with a label and a text."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string"), text_col)
    if len(names := labelled.select(F.col(label_col)).distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MAX_LANGUAGES} values, the first being {sorted(r[0] for r in names)[:5]}")
    counted = labelled.mapInArrow(_count_grams, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counted.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toLocalIterator():  # a label at a time: BUCKETS numbers each
        found[row["label"]] = np.zeros(BUCKETS)
        found[row["label"]][[c["bucket"] for c in row["counts"]]] = [c["n"] for c in row["counts"]]
    languages = sorted(found)
    counts = np.array([found[x] for x in languages]).reshape(len(languages), BUCKETS)
    return Model(languages, counts)


def _predict(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            best = np.full(batch.num_rows, len(model.languages))
            score, lead = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            if model.languages:
                for lo, hi, scan in scans(batch.column(1)):
                    best[lo:hi], score[lo:hi], lead[lo:hi] = model.decode(model.margins(scan))
            none = ~batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            best[none], score[none], lead[none] = len(model.languages), 0.0, 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS_LEAD)], names=["id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and ambiguous of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("has_letter"))
    return rows.mapInArrow(_predict(handle), f"id {kind}, lang_pred string, score double, ambiguous boolean")
