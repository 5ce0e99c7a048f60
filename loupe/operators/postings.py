"""The inverted index as a table: one row a (token, column, document) with its positions.

Written sorted by token, Parquet statistics let a term or a prefix read only its row
groups; a search by postings touches the query's tokens instead of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from .match import Near, NearHit, Phrase, Query, holds, idf_of, term_rank


#: A row holds a token's documents in one block: their ids, lengths and positions (one after another; ``begins`` says where each document's
#: begin), and the bounds that ``Index.top`` reads without them.
BLOCK_ROWS = "token string, column string, block long, n_docs long, most int, shortest int, doc_id array<long>, n_tokens array<int>, begins array<int>, positions array<int>"
_BLOCK = pa.schema([("token", pa.string()), ("column", pa.string()), ("block", pa.int64()), ("n_docs", pa.int64()), ("most", pa.int32()), ("shortest", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def _gathered(toks: pa.ListArray, ids: pa.Array, lengths: np.ndarray, column: str, block: int) -> pa.RecordBatch:
    """One column's rows of a block, by token; toks holds at least one."""
    counts = toks.value_lengths().to_numpy(zero_copy_only=False)
    coded = toks.flatten().dictionary_encode()
    by_token = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_token), np.uint16 if len(by_token) < 1 << 16 else np.int64)  # two bytes are sorted by radix
    rank[by_token.to_numpy()] = np.arange(len(by_token))
    token = rank[coded.indices.to_numpy()]
    order = np.argsort(token, kind="stable")  # of a token: by document and place, as they come
    doc = np.repeat(np.arange(len(ids)), counts)[order]
    place = (np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts))[order].astype(np.int32)
    token = token[order]
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])  # of a document's hits
    hits = np.diff(np.r_[first, len(token)])
    begin = np.flatnonzero(np.r_[True, token[first][1:] != token[first][:-1]])  # of a token's documents
    docs, places = np.r_[begin, len(first)], np.r_[first[begin], len(token)]
    held = lengths[doc[first]]
    inside = first - np.repeat(first[begin], np.diff(docs))
    lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
    return pa.RecordBatch.from_arrays([
        coded.dictionary.take(by_token), pa.array([column] * len(begin), pa.string()), pa.array(np.full(len(begin), block), pa.int64()), pa.array(np.diff(docs), pa.int64()),
        pa.array(np.maximum.reduceat(hits, begin), pa.int32()), pa.array(np.minimum.reduceat(held, begin), pa.int32()),
        lists(docs, ids.take(pa.array(doc[first]))), lists(docs, pa.array(held, pa.int32())), lists(docs, pa.array(inside, pa.int32())), lists(places, pa.array(place)),
    ], schema=_BLOCK)


def by_block(docs: DataFrame, id_col: str, columns: list[str], block_docs: int) -> DataFrame:
    """``BLOCK_ROWS`` of documents as they lie, about so many a block; each document is also held under the empty token.  Nothing is shuffled.

    A block's tokens are coded, sorted and cut as arrays, so a posting is neither a row nor a value of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                part = batch.slice(at, block_docs)
                ids, toks = part.column(0), part.columns[1:]
                lengths = reduce(lambda a, b: a + b, [t.value_lengths().to_numpy(zero_copy_only=False) for t in toks]).astype(np.int32)
                own = pa.array([[""]] * len(ids), pa.list_(pa.string()))
                for column, held in [("", own), *zip(columns, toks, strict=True)]:
                    if len(held.flatten()):
                        yield _gathered(held, ids, lengths, column, block)
                block += 1

    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(tokens(F.col(c)).alias(f"toks{i}") for i, c in enumerate(columns)))
    return each.mapInArrow(run, BLOCK_ROWS)


def in_blocks(postings: DataFrame) -> DataFrame:
    """``BLOCK_ROWS`` of postings with ``block`` and ``n_tokens``: one shuffle."""
    held = postings.groupBy("token", "column", "block").agg(F.collect_list(F.struct("doc_id", "n_tokens", "positions")).alias("d"))
    most = F.array_max(F.transform("d.positions", F.size))
    # where each document's positions begin: the sums of the sizes before it
    sums = F.aggregate("d.positions", F.array(F.lit(0)), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + F.size(x))))
    begins = F.slice(sums, 1, F.size("d"))
    return held.select("token", "column", F.col("block").cast("long").alias("block"), F.size("d").cast("long").alias("n_docs"), most.alias("most"), F.array_min("d.n_tokens").alias("shortest"), "d.doc_id", "d.n_tokens", begins.alias("begins"), F.flatten("d.positions").alias("positions"))


def of_blocks(rows: DataFrame, *others: str) -> DataFrame:
    """token, column, block, other columns, doc_id, n_tokens and positions: ``BLOCK_ROWS`` as postings."""
    own = F.transform("begins", lambda at, i: F.slice("positions", at + 1, F.coalesce(F.get("begins", i + 1), F.size("positions")) - at))
    return rows.select("token", "column", "block", *others, F.inline(F.arrays_zip("doc_id", "n_tokens", own.alias("positions"))))


def occurrences(toks: Column) -> Column:
    """A document's tokens as an array of (token, positions): sorted and cut within the row, so its tokens needn't be rows to be gathered."""
    placed = F.array_sort(F.transform(toks, lambda t, i: F.struct(t.alias("token"), i.alias("p"))))
    begins = lambda held: F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i)["token"] != F.get(held, i - 1)["token"]))

    def cut(held: Column, at: Column) -> Column:
        until = lambda k: F.coalesce(F.get(at, k + 1), F.size(held))
        return F.transform(at, lambda i, k: F.struct(F.get(held, i)["token"].alias("token"), F.transform(F.slice(held, i + 1, until(k) - i), lambda x: x["p"]).alias("positions")))

    none = F.array().cast("array<struct<token:string,positions:array<int>>>")
    return F.when(F.size(toks) > 0, let(placed, lambda held: let(begins(held), lambda at: cut(held, at)))).otherwise(none)


def build(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """token, column, doc_id and positions (array<int>), made within each document's row; nothing is shuffled.  An id comes once."""
    fields = [F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("toks")) for c in columns]
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*fields)).alias("f"))
    words = each.select("doc_id", "f.column", F.explode(occurrences(F.col("f.toks"))).alias("w"))
    return words.select("w.token", "column", "doc_id", "w.positions")


def write(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Range-partitioned and sorted by token: a frequent token spreads over several files by document."""
    postings.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id").write.mode(mode).parquet(path)


def replace_documents(postings: DataFrame, changed: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Postings with the changed documents' rows replaced (a document without text loses its rows)."""
    kept = postings.join(changed.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")
    return kept.unionByName(build(changed, id_col, columns))


def remove_documents(postings: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    return postings.join(gone.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")


def documents_with(postings: DataFrame, terms: list[str], *, prefix: bool = False) -> DataFrame:
    """doc_id of the documents that hold all terms (the last one begun only, with ``prefix``): one aggregation over the terms' rows."""
    tests = [F.col("token") == t for t in terms[:-1]] + [F.startswith("token", F.lit(terms[-1])) if prefix else F.col("token") == terms[-1]]
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    held = postings.where(any_of).groupBy("doc_id").agg(*(F.bool_or(t).alias(f"t{k}") for k, t in enumerate(tests)))
    return held.where(" AND ".join(f"t{k}" for k in range(len(tests)))).select("doc_id")


def phrase_documents(postings: DataFrame, terms: list[str], *, prefix: bool = False) -> DataFrame:
    """doc_id and hits of a phrase: positions shifted by the term's place meet in a group of (document, column, start)."""
    parts = []
    for k, term in enumerate(terms):
        test = F.startswith("token", F.lit(term)) if prefix and k == len(terms) - 1 else F.col("token") == term
        parts.append(postings.where(test).select("doc_id", "column", F.explode("positions").alias("p"), F.lit(k).alias("k")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    starts = rows.groupBy("doc_id", "column", (F.col("p") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(terms))
    return starts.groupBy("doc_id").agg(F.count("*").alias("hits"))


def token_stats(postings: DataFrame) -> DataFrame:
    """token, documents and occurrences."""
    return postings.groupBy("token").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum(F.size("positions")).alias("n_hits"))


def lengths(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id and n_tokens: the narrow table that ranks need beside the postings."""
    return docs.select(F.col(id_col).alias("doc_id"), reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in columns]).alias("n_tokens"))


def _tests(leaf: Phrase) -> list[Column]:
    last = len(leaf.terms) - 1
    return [F.startswith("token", F.lit(t)) if leaf.prefix and k == last else F.col("token") == t for k, t in enumerate(leaf.terms)]


def hits(rows: DataFrame, query: Query, columns: list[str]) -> tuple[DataFrame, dict[Query, Column], dict[Query, Column]]:
    """One row a document that holds any of the query's tokens, with ``doc_id`` and ``n_tokens``; each leaf's condition; each counted leaf's hits.

    rows: postings with ``n_tokens``.  One scan of the query's tokens and one shuffle by document, which sums hits, or
    gathers the positions of phrases and NEARs, whose terms then meet in their document's row.
    """
    leaves = query.leaves()
    phrases = list(dict.fromkeys(p for leaf in leaves for p in (leaf.phrases if isinstance(leaf, Near) else (leaf,))))
    placed = {p for leaf in leaves if isinstance(leaf, Near) for p in leaf.phrases} | {p for p in phrases if len(p.terms) > 1 or p.initial}
    sums, starts = [], {}
    for i, p in enumerate(phrases):
        among = [c for c in columns if p.columns is None or c in p.columns]
        tests = _tests(p)
        if p not in placed:
            test = tests[0] if p.columns is None else tests[0] & F.col("column").isin(among)
            sums.append(F.sum(F.when(test, F.size("positions")).otherwise(0)).alias(f"h{i}"))
            continue
        for c in among:
            sums += [F.flatten(F.collect_list(F.when(t & (F.col("column") == c), F.col("positions")))).alias(f"p{i}_{c}_{j}") for j, t in enumerate(tests)]
        starts[p] = {c: f"s{i}_{c}" for c in among}
    wanted = reduce(lambda a, b: a | b, [t for p in phrases for t in _tests(p)])
    found = rows.where(wanted).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), *sums)

    def meet(i: int, p: Phrase, c: str) -> Column:
        """Positions at which all terms stand, each moved back by its place: sets that are intersected.  Their order doesn't matter."""
        moved = lambda j: F.transform(f"p{i}_{c}_{j}", lambda at: at - j)
        both = reduce(F.array_intersect, map(moved, range(len(p.terms))))
        return F.filter(both, lambda at: at == 0) if p.initial else both

    found = found.select("doc_id", "n_tokens", *(f"h{i}" for i, p in enumerate(phrases) if p not in placed), *(meet(phrases.index(p), p, c).alias(name) for p, of in starts.items() for c, name in of.items()))
    total = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    inside = lambda leaf, k: lambda places: leaf.inside(places, k)
    n = {p: total([F.size(s) for s in starts[p].values()]) if p in placed else F.col(f"h{i}") for i, p in enumerate(phrases)}
    matched: dict[Query, Column] = {p: n[p] > 0 for p in phrases}
    for leaf in leaves:
        if isinstance(leaf, Near):
            places = [F.array(*(F.col(starts[p][c]) for p in leaf.phrases)) for c in starts[leaf.phrases[0]]]
            matched[leaf] = reduce(lambda a, b: a | b, [let(x, leaf.begins) for x in places], F.lit(False))
            for k in range(len(leaf.phrases)):
                n[NearHit(leaf, k)] = total([let(x, inside(leaf, k)) for x in places])
                matched[NearHit(leaf, k)] = matched[leaf.phrases[k]]
    return found, matched, n


def ranked(found: DataFrame, matched: dict[Query, Column], n: dict[Query, Column], query: Query, all_docs: Column, average: Column) -> DataFrame:
    """doc_id and rank (negative BM25) of the matching rows of ``hits``."""
    counted = query.counted()
    leaves = list(dict.fromkeys(leaf for leaf, _ in counted))
    rows = found.select("doc_id", "n_tokens", holds(query, matched).alias("match"), *(n[leaf].alias(f"n{k}") for k, leaf in enumerate(leaves)), *(matched[leaf].alias(f"m{k}") for k, leaf in enumerate(leaves)), *(holds(node, matched).alias(f"c{k}") for k, (_, node) in enumerate(counted)))
    # both sides read the same exchange: the counts ask for all of its columns
    counts = rows.agg(*(F.count_if(f"m{k}").alias(f"d{k}") for k in range(len(leaves))), F.max("n_tokens").alias("longest"), *(F.max(f"n{k}").alias(f"most{k}") for k in range(len(leaves))))
    both = rows.where("match").crossJoin(F.broadcast(counts))  # one row
    parts = []
    for k, (leaf, _) in enumerate(counted):
        i = leaves.index(leaf)
        parts.append(F.when(F.col(f"c{k}") & (F.col(f"most{i}") > 0), term_rank(idf_of(all_docs, F.col(f"d{i}")), F.col(f"n{i}").cast("double"), F.col("n_tokens"), average)).otherwise(0.0))
    return both.where("n_tokens <= longest").select("doc_id", reduce(lambda a, b: a - b, parts, F.lit(0.0)).alias("rank"))


def score(postings: DataFrame, doc_lengths: DataFrame, query: Query, columns: list[str] | None = None) -> DataFrame:
    """doc_id and rank (negative BM25) of the matching documents: reads the query's tokens and the lengths, no text.

    The same numbers as ``search.score`` over token strings.  ``index.Index`` keeps lengths beside the postings and needs no join with them.
    """
    rows = postings.join(doc_lengths, "doc_id") if "n_tokens" not in postings.columns else postings
    totals = doc_lengths.agg(F.count("*"), F.avg("n_tokens")).first()
    found, matched, n = hits(rows, query, columns or ["content"])
    return ranked(found, matched, n, query, F.lit(totals[0]), F.lit(totals[1] or 0.0))
