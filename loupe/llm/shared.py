"""Where intermediate tables go, and small helpers that operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where none is set and Spark is local."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own = tempfile.mkdtemp(prefix="loupe-")
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open:
        _open[-1].append(out)
    return out


_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside go at its end, also if it fails; what the given function stores stays."""
    _open.append([])

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        _open[-1].remove(out)
        if len(_open) > 1:  # the next scope's
            _open[-2].append(out)
        return out

    try:
        yield kept
    finally:
        discard(*_open.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and nothing will read again; those that are gone already don't matter."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with at least so many rows, and with more than 1/HOT_KEYS of all rows, is hot; so fewer than HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str, at_most: int) -> DataFrame:
    """rows left-joined to facts, one row a key, without ``n_col``: a key's number of rows.  ``at_most``: no key has more.

    Facts of hot keys are broadcast, so that no task gets all rows of one key; the others are joined by a shuffle.  Both
    sides are split by the keys' hashes, of which the driver holds the hot ones, fewer than HOT_KEYS.
    """
    if at_most < HOT_ROWS:
        return rows.join(facts.drop(n_col), keys, "left")
    facts = stored(facts, "facts")
    total, most = facts.agg(F.sum(n_col), F.max(n_col)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS + 1)
    if (most or 0) < least:
        return rows.join(facts.drop(n_col), keys, "left")
    spot = F.xxhash64(*keys)
    hot = spot.isin([r[0] for r in facts.where(F.col(n_col) >= least).select(spot).collect()])
    left = rows.where(hot).join(F.broadcast(facts.where(hot).drop(n_col)), keys, "left")
    right = rows.where(~hot).join(facts.where(~hot).drop(n_col), keys, "left")
    return left.unionByName(right)


#: A filter has 16 bits an id, in bitmaps of 32,768 bits (4 KB), and 32 MB at most.
BITMAP_BITS, MOST_BITMAPS = 32_768, 8192


def flag_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with ``__may``, false only where the column ``key`` (long) is null or not among ``ids`` (one column of longs).

    A bitmap of the ids' hashes is broadcast, so rows with large columns that few ids concern needn't be shuffled: an exact join
    follows for those flagged.  Beyond 2^28 ids or so the bitmap fills and flags more, at worst all rows.
    """
    bits = min(ids.count() * 16 // BITMAP_BITS + 1, MOST_BITMAPS) * BITMAP_BITS

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(bits))

    spots = ids.select(place(ids.columns[0]).alias("__spot"))
    maps = spots.groupBy(F.floor(F.col("__spot") / BITMAP_BITS).alias("__map")).agg(F.bitmap_construct_agg(F.col("__spot") % BITMAP_BITS).alias("__bits"))
    spot = F.col("__spot") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("__bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.col(key).isNotNull() & F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), spot % 8).cast("int")) != 0, F.lit(False))
    placed = rows.withColumn("__spot", place(key)).withColumn("__map", F.floor(F.col("__spot") / BITMAP_BITS))
    return placed.join(F.broadcast(maps), "__map", "left").select(*(F.col(f"`{c}`") for c in rows.columns), may.alias("__may"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training(key: str, modulus: int, held_out: int) -> Column:
    """Whether crc32(key as text) mod ``modulus`` is not ``held_out``; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus != held_out, F.lit(False))
