"""Language-model scores: a smoothed word model and a subword lattice likelihood.

The corpus is gathered as one table of distinct words with their counts in training
texts.  The base score reads those counts.  The model's score weights every
segmentation of a word into vocabulary pieces: the vocabulary's own scores weight the
segmentations in one expectation step over all training words, whose expected uses,
smoothed by those scores, become the pieces' probabilities (``adapt=False`` leaves the step
out and keeps the scores).  A log-space forward recursion over each distinct word's lattice
returns its probability summed over all segmentations.  Pieces, byte pieces and the end
token have probabilities that sum to one, and a character without a piece is spelled by
its byte pieces, so no set of texts gets more than one.  No piece crosses a word, so a
text's log probability is the sum over its words, with one end token a text.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased.  Texts are scored against
the table of words, by two 64-bit hashes, in two ways that give the same numbers: the words that make more
than 1/HOT of all training tokens, fewer than HOT by counting, are looked up in
broadcast arrays of 32 bytes a word; the others are counted per text and joined.

Null and empty texts have only the end token; bytes that aren't UTF-8 become replacement
characters first.  A very long text is scanned whole, alone in its chunk.  Rows with a null id
are held out unless ``train`` says otherwise.
Repeated rows count as texts of their own.  Without training texts every count is 0
and the pieces keep the prior.  Other columns are ignored, whatever their names; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import SPACE, LITERAL_SPACE, Lattice, Vocabulary
from .shared import stored
from .textscan import NONSPACE, Scan, keyed, mix, scans

HOT = 1 << 19
#: Characters of words whose lattices are built at once; a longer word has its own.
LATTICE_CHARS = 1 << 19


def _word_bytes(scan: Scan, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = scan.data.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _hash_pairs(scan: Scan, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and both in one for comparisons inside a chunk."""
    h1, h2 = scan.hashes(starts, ends, 0), scan.hashes(starts, ends, 1)
    return h1, h2, h1 ^ mix(h2)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch, with their counts in its training texts."""
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False)
        table: dict[bytes, list[int]] = {}
        for lo, _, scan in scans(batch.column(0)):
            low = scan.lowered()
            s, e, owner = low.spans(NONSPACE)
            h1, h2, both = _hash_pairs(low, s, e)
            _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, weights=train[lo + owner], minlength=len(first)).astype(np.int64)
            for word, x, y, c in zip(_word_bytes(low, s[first], e[first]), h1[first].view(np.int64).tolist(), h2[first].view(np.int64).tolist(), counts.tolist(), strict=True):
                have = table.get(word)
                if have is None:
                    table[word] = [x, y, c]
                else:
                    have[2] += c
        if table:
            h1, h2, c = zip(*table.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(list(table), pa.binary()).cast(pa.string()), pa.array(c, pa.int64())], names=["hash", "hash2", "word", "c"])


def _lattices(words: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, int, Lattice]]:
    """First word, word after the last, and lattice of portions of bounded size."""
    upto = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LATTICE_CHARS, "right")))
        yield lo, hi, Lattice(_marked(words.slice(lo, hi - lo).to_pylist()), vocabulary)
        lo = hi


def _marked(words: list[str]) -> list[str]:
    return [SPACE + w.replace(SPACE, LITERAL_SPACE) for w in words]


def _expect(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = handle.value
        uses = np.zeros(vocabulary.n)
        for batch in batches:
            times = batch.column(1).to_numpy().astype(float)
            for lo, hi, lattice in _lattices(batch.column(0), vocabulary):
                uses += lattice.expected(vocabulary.scores, times[lo:hi])
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(uses[at])], names=["piece", "uses"])

    return run


def _weigh(vocabulary_handle, scores_handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [lattice.forward(scores_handle.value)[lattice.final] for _, _, lattice in _lattices(batch.column(2), vocabulary_handle.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.concatenate(weights or [np.zeros(0)]))], names=["hash", "hash2", "c", "log_p"])

    return run


def piece_model(words: DataFrame, n_texts: int, vocabulary: Vocabulary, handle, adapt: bool) -> tuple[np.ndarray, float]:
    """Log probabilities of pieces (natural), and of the end token; together they are one.

    Without ``adapt`` pieces keep the vocabulary's own scores, scaled to leave the end its share; with it, they are
    the expected uses of one step over all training words, smoothed by these scores.
    """
    prior, strength = np.exp(vocabulary.scores), float(vocabulary.n)
    if adapt:
        rows = words.where("c > 0").select("word", "c").mapInArrow(_expect(handle), "piece int, uses double")
        got = rows.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row a piece at most
        uses = np.zeros(vocabulary.n)
        uses[got["piece"].to_numpy()] = got["uses"].to_numpy()
        weight, end = uses + strength * prior, n_texts + 1.0
    else:
        n_words = words.agg(F.sum("c")).first()[0] or 0
        weight, end = prior * (n_words + strength), n_texts + 1.0  # an end after so many words
    total = weight.sum() + end
    return np.log(weight / total, out=np.full(len(weight), -np.inf), where=weight > 0), float(np.log(end / total))


_SUMS = "n_tokens long, n_known long, base double, log_p double"


def _score(hot_handle, denominator: float):
    """A row of sums a text (times = 0) and a row (hash, hash2, times) for each of its words that isn't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, keys2, counts, weights = hot_handle.value
        logs = np.log10((counts + 1) / denominator)
        for batch in batches:
            uid = batch.column(1).to_numpy()
            carried = batch.select(["id", "train"])
            for lo, hi, scan in scans(batch.column(0)):
                low = scan.lowered()
                s, e, owner = low.spans(NONSPACE)
                h, h2, both = _hash_pairs(low, s, e)
                _, first, times = np.unique(keyed(both, owner), return_index=True, return_counts=True)
                h, h2, owner = h[first], h2[first], owner[first]
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = (keys[at] == h) & (keys2[at] == h2) if len(keys) else np.zeros(len(h), bool)
                o, k, t = owner[hit], at[hit], times[hit]
                sums = lambda w, o=o, n=scan.n: np.bincount(o, weights=w, minlength=n)
                known = sums(t * (counts[k] > 0)).astype(np.int64)
                tokens = np.bincount(owner, weights=times, minlength=scan.n).astype(np.int64)
                rest, n = np.flatnonzero(~hit), scan.n
                zeros = np.zeros(len(rest))
                columns = [
                    np.concatenate([uid[lo:hi], uid[lo + owner[rest]]]),
                    np.concatenate([uid[lo:hi], h[rest].view(np.int64)]),  # a text's own row joins nothing that counts: its times are 0
                    np.concatenate([np.zeros(n, np.int64), h2[rest].view(np.int64)]),
                    np.concatenate([np.zeros(n, np.int64), times[rest]]),
                    np.concatenate([tokens, zeros.astype(np.int64)]),
                    np.concatenate([known, zeros.astype(np.int64)]),
                    np.concatenate([sums(t * logs[k]), zeros]),
                    np.concatenate([sums(t * weights[k]), zeros]),
                ]
                ids, trains = carried.take(pa.array(np.concatenate([np.arange(lo, hi), lo + owner[rest]]))).columns
                yield pa.RecordBatch.from_arrays([ids, trains, *(pa.array(c) for c in columns)], names=["id", "train", "uid", "hash", "hash2", "times", "n_tokens", "n_known", "base", "log_p"])

    return run


def score(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary_path: str | None = None, adapt: bool = True, hot: int = HOT) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score and score of every row; ``train`` is an SQL condition on docs."""
    spark = docs.sparkSession
    flagged = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    words = flagged.select("text", "train").mapInArrow(_gather, "hash long, hash2 long, word string, c long").groupBy("hash", "hash2", "word").agg(F.sum("c").alias("c"))
    words = stored(words, "lm-words")
    n_texts = flagged.where("train").count()
    n_words, distinct = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n_all = (n_words or 0) + n_texts
    vocabulary = Vocabulary(vocabulary_path)
    handle = spark.sparkContext.broadcast(vocabulary)
    pieces, end_p = piece_model(words, n_texts, vocabulary, handle, adapt)
    denominator = float(n_all + (distinct or 0) + (n_texts > 0) + 1)
    weighed = stored(words.mapInArrow(_weigh(handle, spark.sparkContext.broadcast(pieces)), "hash long, hash2 long, c long, log_p double"), "lm-weights")
    top = weighed.where(F.col("c") > n_all / hot).toArrow()  # fewer than ``hot`` words
    order = np.argsort(top["hash"].to_numpy().view(np.uint64))
    arrays = (*(top[c].to_numpy().view(np.uint64)[order] for c in ("hash", "hash2")), top["c"].to_numpy()[order], top["log_p"].to_numpy()[order])
    rows = flagged.select("text", F.monotonically_increasing_id().alias("uid"), "id", "train")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = rows.mapInArrow(_score(spark.sparkContext.broadcast(arrays), denominator), f"id {kind}, train boolean, uid long, hash long, hash2 long, times long, {_SUMS}")
    joined = parts.join(weighed.withColumnRenamed("log_p", "w"), ["hash", "hash2"], "left").withColumns({"c": F.coalesce("c", F.lit(0)), "w": F.coalesce("w", F.lit(0.0))})
    sums = joined.groupBy("uid", "id", "train").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(denominator)))).alias("base"),
        (F.sum("log_p") + F.sum(F.col("times") * F.col("w"))).alias("log_p"),
    )
    ends = float(np.log10((n_texts + 1) / denominator))
    return sums.select(
        "id",
        "train",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + int(n_texts > 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + ends).alias("base_score"),
        ((F.col("log_p") + end_p) / float(np.log(10))).alias("score"),
    )
