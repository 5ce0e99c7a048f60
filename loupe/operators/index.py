"""A full-text index kept as segments of postings, updated at the cost of what changed.

A segment is a folder of postings, each file sorted by token and block, as its documents lay (merged segments: dealt by ranges): a row holds the ids, lengths and positions of all of a block's documents with
the token in the column; documents are also held under the empty token, so lengths come from the same pass.  A change writes
one new segment with the changed documents' postings and the ids whose older postings are dead from now on; nothing else is
touched.  The manifest's last row names the live segments and the corpus totals, and is written last: a crash before it
leaves the index as it was, and the next change writes that segment's number again.  ``compact`` merges the smallest
segments.  Readers drop dead postings by a join with the dead ids (few, so usually a broadcast).

``search`` ranks by one scan of the query's tokens and one shuffle.  ``top`` reads small columns of these rows first
(a token's most hits and shortest document in the block), and then only the blocks whose best possible rank reaches the k-th
best found so far.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import postings as books
from .match import Near, Phrase, Query, holds, idf_of, term_rank
from .staging import discard, folders_in, remove_folder, staged

#: Documents of a block, about.
BLOCK_DOCS = 256
_ROW_GROUP = 16 << 20
_MANIFEST = "segment int, segments array<int>, sizes array<long>, n_docs long, n_tokens long, has_dead boolean"


@dataclasses.dataclass
class Manifest:
    segment: int
    segments: list[int]
    sizes: list[int]
    n_docs: int
    n_tokens: int
    has_dead: bool

    @property
    def average(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


class Index:
    def __init__(self, spark: SparkSession, path: str, columns: list[str]):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), list(columns)
        self._read: tuple[str, Manifest] | None = None

    def manifest(self) -> Manifest:
        """The last manifest row; it is read again only when there is a newer one."""
        written = folders_in(self.spark, f"{self.path}/manifest", written=True)
        if not written:
            return Manifest(-1, [], [], 0, 0, False)
        last = max(written, key=lambda name: int(name.partition("=")[2]))
        if self._read is None or self._read[0] != last:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{last}").first()
            self._read = last, Manifest(**row.asDict())
        return self._read[1]

    def _table(self, name: str, segments: list[int], schema: str) -> DataFrame:
        """A table's live segments, with the column ``segment``."""
        if not segments:
            return self.spark.createDataFrame([], schema + ", segment int")
        return self.spark.read.schema(schema + ", segment int").option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/segment={s}" for s in segments))

    def _dead(self, now: Manifest) -> DataFrame:
        """doc_id and the segment before which its postings are dead."""
        first = min(now.segments)
        gone = self._table("gone", [s for s in range(first + 1, now.segment + 1)], "doc_id long")
        return gone.groupBy("doc_id").agg(F.max("segment").alias("dead_before"))

    def rows(self, now: Manifest | None = None) -> DataFrame:
        """All live rows, those of documents under the empty token too."""
        now = now or self.manifest()
        found = books.of_blocks(self._table("postings", now.segments, books.BLOCK_ROWS), "segment")
        if not now.has_dead:
            return found
        held = found.join(self._dead(now), "doc_id", "left").where("dead_before IS NULL OR segment >= dead_before")
        return held.select(*found.columns)

    def postings(self) -> DataFrame:
        return self.rows().where("token <> ''")

    def documents(self) -> DataFrame:
        """doc_id and n_tokens."""
        return self.rows().where("token = ''").select("doc_id", "n_tokens")

    # -- changes

    def _commit(self, now: Manifest, rows: DataFrame, gone: DataFrame | None, keep: list[int]) -> Manifest:
        """Writes segment now.segment + 1 and then its manifest row."""
        number = now.segment + 1
        at = f"segment={number}"
        rows.sortWithinPartitions("token", "block").write.mode("overwrite").option("parquet.block.size", _ROW_GROUP).parquet(f"{self.path}/postings/{at}")
        (self.spark.createDataFrame([], "doc_id long") if gone is None else gone).write.mode("overwrite").parquet(f"{self.path}/gone/{at}")
        size = self.spark.read.schema(books.BLOCK_ROWS).parquet(f"{self.path}/postings/{at}").agg(F.sum("n_docs")).first()[0] or 0
        segments = [*keep, number]
        sizes = [dict(zip(now.segments, now.sizes, strict=True))[s] for s in keep] + [size]
        has_dead = bool(keep) and (now.has_dead or gone is not None)
        totals = Manifest(number, segments, sizes, 0, 0, has_dead)
        live = self.rows(totals).where("token = ''").agg(F.count("*"), F.sum("n_tokens")).first()  # the narrow rows of documents only
        totals = dataclasses.replace(totals, n_docs=live[0], n_tokens=live[1] or 0)
        self._read = None  # a crash may have left a row of this number
        self.spark.createDataFrame([dataclasses.astuple(totals)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/at={number}")
        return totals

    def replace(self, docs: DataFrame, id_col: str) -> Manifest:
        """Puts documents in, in place of their older versions.  An id comes once; of texts that are null nothing is found."""
        now = self.manifest()
        gone = docs.select(F.col(id_col).cast("long").alias("doc_id")) if now.segments else None
        return self._commit(now, books.by_block(docs, id_col, self.columns, BLOCK_DOCS), gone, now.segments)

    def remove(self, ids: DataFrame, id_col: str) -> Manifest:
        now = self.manifest()
        return self._commit(now, self.spark.createDataFrame([], books.BLOCK_ROWS), ids.select(F.col(id_col).cast("long").alias("doc_id")), now.segments)

    def compact(self, at_most: int = 4) -> Manifest:
        """Merges the smallest segments, if there are more than so many; their folders stay until ``clean``."""
        now = self.manifest()
        if len(now.segments) <= at_most:
            return now
        by_size = sorted(zip(now.sizes, now.segments, strict=True))[: len(now.segments) - at_most + 1]
        merged = [s for _, s in by_size]
        rows = self.rows(now).where(F.col("segment").isin(merged)).drop("segment")
        blocks = sum(n for n, _ in by_size) and rows.where("token = ''").count() // BLOCK_DOCS + 1
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
        rows = staged(books.in_blocks(dealt), "postings")  # dealing by ranges reads them twice
        made = self._commit(now, rows.repartitionByRange("token", "block"), None, [s for s in now.segments if s not in merged])
        discard(rows)
        return made

    def clean(self) -> None:
        """Deletes folders of segments that the manifest no longer names; nothing may be reading them."""
        now = self.manifest()
        for s in range(now.segment + 1):
            if s not in now.segments:
                remove_folder(self.spark, f"{self.path}/postings/segment={s}")

    # -- search

    def _hits(self, rows: DataFrame, query: Query, now: Manifest) -> DataFrame:
        found, matched, n = books.hits(rows, query, self.columns)
        return books.ranked(found, matched, n, query, F.lit(now.n_docs), F.lit(now.average))

    def search(self, query: Query) -> DataFrame:
        """doc_id and rank (negative BM25) of all matching documents."""
        now = self.manifest()
        return self._hits(self.rows(now).where("token <> ''"), query, now)

    def top(self, query: Query, k: int, *, count_blocks: bool = False) -> tuple[DataFrame, dict[str, int]]:
        """The k best of ``search`` (ties to the smaller id), and with ``count_blocks`` how many blocks may hold a match and how many are read.

        Blocks are skipped for conditions of whole words of one column's index; others are searched in full.
        """
        now = self.manifest()
        best = lambda rows: rows.orderBy("rank", "doc_id").limit(k)
        words = query.leaves()
        if len(self.columns) > 1 or any(isinstance(w, Near) or len(w.terms) > 1 or w.prefix or w.initial or w.columns for w in words):
            return best(self._hits(self.rows(now).where("token <> ''"), query, now)), {}
        live = self.rows(now)
        n = self._document_counts(live, words, now)
        idf = [idf_of(F.lit(now.n_docs), F.lit(n[w])) for w in words]
        blocks = self._bounds(query, words, idf, now)  # from small columns, so it isn't stored
        first = blocks.orderBy(F.desc("bound"), "segment", "block").limit(max(1, min(k, 64)))  # enough to find k good ones, usually
        seen = self._scored(live, first, query, words, idf, now)
        kth = [r["rank"] for r in best(seen).select("rank").collect()]
        least = -kth[-1] if len(kth) == k else 0.0
        wanted = blocks.where(F.col("bound") >= least * (1 - 1e-9))
        report = {"blocks": blocks.count(), "read": wanted.count()} if count_blocks else {}
        return best(self._scored(live, wanted, query, words, idf, now)), report

    def _document_counts(self, live: DataFrame, words: list[Phrase], now: Manifest) -> dict[Phrase, int]:
        """How many live documents hold each word: from the blocks' counts, or from the words' rows where some are dead."""
        terms = [w.terms[0] for w in words]
        if now.has_dead:
            counts = live.where(F.col("token").isin(terms)).groupBy("token").agg(F.count("*").alias("n"))
        else:
            counts = self._blocks(now).where(F.col("token").isin(terms)).groupBy("token").agg(F.sum("n_docs").alias("n"))
        found = {r["token"]: r["n"] for r in counts.collect()}  # a row a word of the query
        return {w: found.get(w.terms[0], 0) for w in words}

    def _blocks(self, now: Manifest) -> DataFrame:
        found = self._table("postings", now.segments, books.BLOCK_ROWS).where("token <> ''")
        return found.select("token", "column", "block", "n_docs", "most", "shortest", "segment")

    def _bounds(self, query: Query, words: list[Phrase], idf: list[Column], now: Manifest) -> DataFrame:
        """segment, block, n_docs and bound: the best negative rank that a document of the block can have, where the block can match."""
        rows = self._blocks(now).where(F.col("token").isin([w.terms[0] for w in words]))
        has = [F.col("token") == w.terms[0] for w in words]
        each = rows.groupBy("segment", "block").agg(*(F.max(F.when(t, F.col("most"))).alias(f"most{i}") for i, t in enumerate(has)), *(F.min(F.when(t, F.col("shortest"))).alias(f"short{i}") for i, t in enumerate(has)), F.max("n_docs").alias("n_docs"))
        part = {w: F.when(F.col(f"most{i}").isNotNull(), term_rank(idf[i], F.col(f"most{i}").cast("double"), F.col(f"short{i}"), F.lit(now.average))).otherwise(0.0) for i, w in enumerate(words)}
        bound = reduce(lambda a, b: a + b, [part[leaf] for leaf, _ in query.counted()], F.lit(0.0))
        return each.where(_may(query, {w: F.col(f"most{i}").isNotNull() for i, w in enumerate(words)})).select("segment", "block", "n_docs", bound.alias("bound"))

    def _scored(self, live: DataFrame, blocks: DataFrame, query: Query, words: list[Phrase], idf: list[Column], now: Manifest) -> DataFrame:
        """doc_id and rank of the blocks' matching documents."""
        rows = live.where(F.col("token").isin([w.terms[0] for w in words])).join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        tf = [F.sum(F.when(F.col("token") == w.terms[0], F.size("positions")).otherwise(0)).alias(f"h{i}") for i, w in enumerate(words)]
        found = rows.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), *tf)
        matched = {w: F.col(f"h{i}") > 0 for i, w in enumerate(words)}
        part = lambda leaf, node: F.when(holds(node, matched), term_rank(idf[words.index(leaf)], F.col(f"h{words.index(leaf)}").cast("double"), F.col("n_tokens"), F.lit(now.average))).otherwise(0.0)
        return found.where(holds(query, matched)).select("doc_id", reduce(lambda a, b: a - b, [part(leaf, node) for leaf, node in query.counted()], F.lit(0.0)).alias("rank"))


def _may(query: Query, present: dict[Query, Column]) -> Column:
    """Whether a block with these words can hold a match: what must be absent doesn't count."""
    if isinstance(query, Phrase):
        return present[query]
    sides = _may(query.a, present), _may(query.b, present)
    return sides[0] if query.is_without else sides[0] | sides[1] if query.is_either else sides[0] & sides[1]
