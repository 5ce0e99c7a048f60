"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of the rows over its present share; a document
is repeated Poisson(rate) times, by inverting the distribution at a number in [0, 1)
that hashes the seed and the row's key, so a rerun or a retried task repeats it
exactly.  A rate above LARGEST_RATE is drawn as a sum of independent draws of at most that
rate, so a source's table of cumulative probabilities stays short.  Copies are then dealt over all partitions by a hash of (key, copy) and
sorted by it: a global shuffle.  A row of a source with a rate above MANY is first dealt in
blocks of that many copies, so that no task makes all copies of one row.

Rows with a null source form a source of their own; null weights count as 0, sources
without a weight get weight 1.  Very long texts are carried whole.  A null key hashes like the text 'null', so such rows
share one draw; repeated rows get equal draws.  An empty table gives an empty one.
Columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One inversion's largest mean: its table has at most 164 steps.
LARGEST_RATE = 64.0
#: The table of sources is broadcast up to this many rows, of a name and at most 164 doubles.
MAX_BROADCAST_SOURCES = 20_000
#: Beyond it, each source's row is repeated so often and its documents are dealt over the repeats.
SALTS = 64
#: Copies of a row that one task makes at once.
MANY = 1000


def unit(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 random bits from md5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of Poisson(rate) for 0, 1, ..., to ten deviations over the mean."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log = F.when(k == 0, -rate).otherwise(acc["log"] + F.ln(rate) - F.ln(k.cast("double")))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    steps = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def _steps_of(rate: float) -> list[float]:
    """``poisson_steps`` of a constant."""
    out, total, log = [], 0.0, -rate
    for k in range(math.ceil(rate + 10 * math.sqrt(rate) + 20) + 1):
        log += math.log(rate / k) if k else 0.0
        total += math.exp(log)
        out.append(total)
    return out


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, default: str = "1.0") -> DataFrame:
    """One row per source: rows, target share, rate, and the draws it takes: ``blocks`` of LARGEST_RATE and one with ``steps``.

    ``weights`` maps sources to weights; others get the SQL expression ``default`` over ``n_rows``.
    """
    weight = F.expr(default).cast("double")
    if weights:  # one map, however many weights
        given = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*(F.lit(float(v or 0)) for v in weights.values())))
        weight = F.coalesce(F.try_element_at(given, F.col("source_key")), weight)
    counts = docs.groupBy(F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("join_key"), F.col(source_col).cast("string").alias("source_key")).agg(F.count("*").alias("n_rows"))
    counts = counts.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    totals = counts.agg(F.sum("n_rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    shares = counts.crossJoin(F.broadcast(totals)).withColumn("target_share", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0))
    rates = shares.withColumn("rate", F.col("target_share") * F.col("all_rows") / F.col("n_rows"))
    blocks = F.greatest(F.ceil(F.col("rate") / LARGEST_RATE) - 1, F.lit(0)).cast("int")
    return rates.select("join_key", "source_key", "n_rows", "target_share", "rate", blocks.alias("blocks"), poisson_steps(F.col("rate") - blocks * LARGEST_RATE).alias("steps"))


def poisson_count(u: Column, steps: Column) -> Column:
    """The Poisson number at u: how many steps it has passed."""
    return F.size(F.filter(steps, lambda c: c <= u))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, default_weight: str = "1.0", key_col: str = "doc_id", source_col: str = "source", seed: str = "mix-1", max_broadcast: int = MAX_BROADCAST_SOURCES, salts: int = SALTS, many: int = MANY) -> DataFrame:
    """All columns of docs for each copy, with ``copy`` (int, from 1) and ``shuffle_key`` (long), in shuffled order."""
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, source_col, weights, default_weight).select("join_key", "blocks", "steps")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("join_key"), F.col(key_col).cast("string").alias("draw_key"), unit(seed, F.col(key_col)).alias("u"))
    if len(rates.select("join_key").take(max_broadcast + 1)) <= max_broadcast:
        joined = rows.join(F.broadcast(rates), "join_key")
    else:
        rows = rows.withColumn("salt", F.floor(F.col("u") * 1e6).cast("int") % salts)
        rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(rates, ["join_key", "salt"])
    whole = F.array(*map(F.lit, _steps_of(LARGEST_RATE)))
    more = F.aggregate(F.sequence(F.lit(1), F.col("blocks")), F.lit(0), lambda n, j: n + poisson_count(unit(seed, F.col("draw_key"), j), whole))
    times = poisson_count(F.col("u"), F.col("steps")) + F.when(F.col("blocks") > 0, more).otherwise(0)
    counted = joined.withColumn("times", times).where("times > 0")
    largest = many if not rates.where((F.col("blocks") + 1) * LARGEST_RATE >= many).isEmpty() else 0
    return shuffled(_copies(counted, largest, many), key_col, seed)


def _copies(counted: DataFrame, largest: int, many: int) -> DataFrame:
    """row and copy (from 1) for each of a row's ``times``, of which none is above ``largest`` where that is below ``many``."""
    if largest < many:
        return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    blocks = counted.select("row", "times", F.explode(F.sequence(F.lit(1), F.col("times"), F.lit(many))).alias("at"))
    dealt = blocks.repartition(F.xxhash64("row", "at"))
    return dealt.select("row", F.explode(F.sequence(F.col("at"), F.least("times", F.col("at") + many - 1))).alias("copy"))


def shuffled(copies: DataFrame, key_col: str, seed: str) -> DataFrame:
    """All columns of ``row``, ``copy`` and ``shuffle_key``, in the order of this hash of key and copy."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col(f"row.{key_col}").cast("string"), F.lit("null")), F.col("copy"))), 1, 15), 16, 10).cast("long")
    dealt = copies.select("row.*", "copy", place.alias("shuffle_key"))
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def numbered_copies(docs: DataFrame, key_col: str = "doc_id", seed: str = "mix-1", many: int = MANY) -> DataFrame:
    """docs with equal rows numbered by ``copy`` (int, from 1), in the order in which ``mix_sources`` leaves its copies.

    Equal rows are counted before the shuffle and made again after it, so a row with very many copies doesn't meet in one task.
    """
    docs = docs.drop("copy", "shuffle_key")
    largest = docs.groupBy(key_col).count().agg(F.max("count")).first()[0] or 0
    equal = docs.groupBy(*(F.col(f"`{c}`") for c in docs.columns)).agg(F.count("*").cast("int").alias("__times"))
    counted = equal.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("__times").alias("times"))
    return shuffled(_copies(counted, largest, many), key_col, seed).drop("shuffle_key")
