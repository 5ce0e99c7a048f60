"""Joins of rows to facts, one row a key, that hold when a few keys have most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least so many rows, and with more than 1/HOT_KEYS of all rows, is hot; so fewer than HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 1000, 10_000
#: Bytes of long values that one task of a join reads, about.
TASK_BYTES = 32 << 20


def partitions(spark: SparkSession, n_bytes: int) -> int | None:
    """How many partitions a join of so many bytes is dealt into; None (Spark's choice) where one task could read all."""
    return None if n_bytes <= TASK_BYTES else max(spark.sparkContext.defaultParallelism, n_bytes // TASK_BYTES + 1)


def join_facts(rows: DataFrame, keys: list[str], facts: DataFrame, fact_keys: list[str], how: str = "left", parts: int | None = None) -> DataFrame:
    """rows ⋈ facts on keys = fact_keys, which are unique in facts.  rows should be a stored table: its keys are counted first.

    Facts of hot keys are broadcast, so that no task gets all rows of one key; the others are joined by a shuffle.  Both sides are
    split by the keys' hashes, of which the driver holds the hot ones, fewer than HOT_KEYS.  With ``parts`` both sides of the shuffle are
    dealt into so many partitions by key: a join that Spark turns into a broadcast while it runs otherwise reads the other side by the
    tasks that wrote it, however uneven these are.
    """

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [a[k] == b[f] for k, f in zip(keys, fact_keys, strict=True)], how)

    def dealt(a: DataFrame, b: DataFrame) -> DataFrame:
        return joined(a, b) if parts is None else joined(a.repartition(parts, *keys), b.repartition(parts, *fact_keys))

    total = rows.count()
    if total < HOT_ROWS:
        return dealt(rows, facts)
    counts = rows.groupBy(F.xxhash64(*keys).alias("spot")).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.where(F.col("n") >= max(HOT_ROWS, total // HOT_KEYS + 1)).collect()]
    if not hot:
        return dealt(rows, facts)
    here, there = F.xxhash64(*keys).isin(hot), F.xxhash64(*fact_keys).isin(hot)
    return joined(rows.where(here), F.broadcast(facts.where(there))).unionByName(dealt(rows.where(~here), facts.where(~there)))
