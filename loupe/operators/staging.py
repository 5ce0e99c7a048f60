"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where none is set and Spark is local."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own = tempfile.mkdtemp(prefix="loupe-")
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so a loop's plan doesn't grow and lost executors cost one step."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``staged`` wrote and nothing will read again."""
    for df in tables:
        remove_folder(df.sparkSession, df.staged_at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, wherever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders_in(spark: SparkSession, path: str, *, written: bool = False) -> list[str]:
    """Names of the folders in path, or of those only whose writing has ended; no job runs for it."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    store = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(of(path)):
        return []
    names = [s.getPath().getName() for s in store.listStatus(of(path)) if s.isDirectory()]
    return [n for n in names if not written or store.exists(of(f"{path}/{n}/_SUCCESS"))]
