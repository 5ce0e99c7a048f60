"""From raw documents to training ids, in five stages.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: lines that many documents share stay in one document only.
3. near_dup: of every group of near duplicates one document stays.
4. mix: documents are repeated to their sources' target weights and shuffled.
5. encode: every text becomes sampled piece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last
return the columns of documents.  ``run`` writes each stage's result to the shared
folder and reads it back, so a lost executor costs one stage's tasks at most.
Near duplicates are taken at five words a shingle and a similarity of 0.8, as everywhere but
in op2_near_duplicates, whose contract says four words.

Null ids pass every stage; a null text is never rejected as toxic for its lack of words and
becomes an empty one in stage 2.  Empty texts are linked with nothing and have no ids in the
end.  Very long texts are read whole by every stage.  Ties: a shared line stays with the
largest doc_id, a group of near duplicates with the smallest.  Repeated rows of one doc_id
count as one document in stage 2, and one of them stays in stage 3.  Copies that stage 4
makes of a document have its doc_id; stage 5 numbers equal rows again and seeds by (doc_id, number), so each
is segmented by a draw of its own.
Other columns, whatever their names, are carried by the first four stages, but for
``copy`` and ``shuffle_key``, which stage 4 drops.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import line_dedup, mixing, near_dup, pieces, toxicity
from loupe.llm.queries import fit_toxicity
from loupe.llm.shared import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, fit_toxicity(spark, docs, sf_dir))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, default_weight="sqrt(n_rows)").drop("copy", "shuffle_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = mixing.numbered_copies(docs).withColumn("__draw", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy"))
    rows = pieces.encode(numbered, "__draw")
    return rows.select("row.doc_id", "row.lang", "row.source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "lossless", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dup", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The first and the last stage can't be put in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
