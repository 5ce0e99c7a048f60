"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text's spaces become the piece space mark, a mark is put in front, and the text falls
into words at which no piece can cross (before a run of marks, and at line ends), so
the text's lattice is a chain of word lattices.  Forward filtering sums the weights of
all segmentations up to each character; backward sampling draws one from the text's
end.  The draws hash the seed, the row's key and the place in the row: a retried task,
another partitioning or another cluster gives the same ids.

Decoding joins the bytes of the pieces and takes the mark in front away; it returns the
text for every segmentation.  Characters without a piece, and a literal mark, are
encoded by their bytes.

A null text has null ids and decodes to null; an empty one has no ids and decodes to the
empty text; bytes that aren't UTF-8 become replacement characters first.  A very long text
is encoded whole, alone in its batch.  Rows with equal keys draw equal numbers, so repeated
rows and copies of a document get equal ids.  A null key is a key like any other.  Other
columns, whatever their names, are carried in ``row``.  An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import LITERAL_SPACE, SPACE, Lattice, Vocabulary
from .textscan import mix

#: Sharpness of the sampling: weights are scores to this power; 1 samples by the scores, large values take the best.
ALPHA = 1.0
#: Characters of text whose words share one lattice batch.
BATCH_CHARS = 1 << 17

_CUT = "\ud801"  # between words; like LITERAL_SPACE it occurs in no text


def _split(text: str) -> list[str]:
    """The words of a text: each run of marks begins one, and a line end is one."""
    if not text:
        return []
    marked = SPACE + text.replace(SPACE, LITERAL_SPACE).replace(" ", SPACE)
    cut = marked.replace("\n", f"{_CUT}\n{_CUT}").replace(SPACE, _CUT + SPACE)
    while f"{SPACE}{_CUT}{SPACE}" in cut:
        cut = cut.replace(f"{SPACE}{_CUT}{SPACE}", SPACE + SPACE)
    return list(filter(None, cut.split(_CUT)))


def encode_texts(texts: list[str | None], seeds: np.ndarray, vocabulary: Vocabulary, alpha: float = ALPHA) -> list[np.ndarray | None]:
    """Sampled piece ids of each text (None for None); seeds: uint64 a text."""
    split = [None if t is None else _split(t) for t in texts]
    n_words = np.array([len(w or ()) for w in split])
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word gets the next number
    words = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(part or () for part in split)), np.int64, int(n_words.sum()))
    numbers.default_factory = None  # a bound method of its own dict: a cycle that would keep the words
    if not len(words):
        return [None if t is None else np.zeros(0, np.int32) for t in texts]
    lattice = Lattice(list(numbers), vocabulary)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    stream = mix(np.repeat(seeds, n_words) + mix(place.astype(np.uint64)))

    def noise(which: np.ndarray, step: int) -> np.ndarray:
        return (mix(stream[which] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) / float(1 << 53)

    edges, n_edges = lattice.sample(vocabulary.scores * alpha, words, noise)
    ids, sizes = lattice.piece[edges], np.ones(len(edges), np.int64)
    odd = np.flatnonzero(ids >= vocabulary.n)
    if len(odd):
        spelled = [lattice.spelling[i - vocabulary.n] for i in ids[odd].tolist()]
        sizes[odd] = [len(x) for x in spelled]
        ids = np.repeat(ids, sizes)
        at = (np.cumsum(sizes) - sizes)[odd]
        for k in range(4):
            has = np.flatnonzero(sizes[odd] > k)
            ids[at[has] + k] = [spelled[i][k] for i in has.tolist()]
    per_text = np.zeros(len(texts), np.int64)
    np.add.at(per_text, np.repeat(np.repeat(np.arange(len(texts)), n_words), n_edges), sizes)
    cuts = np.cumsum(per_text)
    return [None if t is None else ids[b - n : b].astype(np.int32, copy=False) for t, b, n in zip(texts, cuts, per_text, strict=True)]


def decode_ids(ids: np.ndarray | None, raw: list[bytes]) -> str | None:
    """The text of piece ids; raw: Vocabulary.raw()."""
    if ids is None:
        return None
    data = b"".join([raw[i] for i in ids.tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BATCH_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if len(texts) > lo:
        yield lo, len(texts)


def _encode(handle, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, raw = handle.value, handle.value.raw()
        for batch in batches:
            texts, seeds = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            for lo, hi in _portions(texts):
                ids = encode_texts(texts[lo:hi], seeds[lo:hi], vocabulary, alpha)
                same = [decode_ids(x, raw) == t for x, t in zip(ids, texts[lo:hi], strict=True)]
                n = np.array([0 if x is None else len(x) for x in ids])
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]))
                lists = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([x is None for x in ids]))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), lists, pa.array(same, pa.bool_())], names=["row", "ids", "lossless"])

    return run


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *, vocabulary_path: str | None = None, alpha: float = ALPHA, seed: int = 1) -> DataFrame:
    """row (a struct of docs' columns but the text), ids (array<int>) and lossless: whether decoding gave the text back."""
    vocabulary = Vocabulary(vocabulary_path)
    handle = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model file
    rest = [c for c in docs.columns if c != text_col]
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(key_col).cast("string"), F.lit("null")))
    rows = docs.select(F.make_valid_utf8(F.col(text_col)).alias("text"), key.alias("seed"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    return rows.mapInArrow(_encode(handle, alpha), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, lossless boolean")


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", *, vocabulary_path: str | None = None) -> DataFrame:
    """rows with the text of their ids in ``out_col``."""
    handle = rows.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path).raw())
    packed = rows.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(None if x is None else np.array(x, np.int64), handle.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return found.select(*(F.col(f"row.`{c}`") for c in rows.columns if c != out_col), F.col("text").alias(out_col))
