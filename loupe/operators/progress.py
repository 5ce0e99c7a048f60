"""Counts of a running job, gathered while it writes: no second pass over its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Files listed, read and failed of one reindex job; ``counts`` waits for the job that writes what was observed."""

    def __init__(self) -> None:
        self._listed, self._read = Observation(), Observation()

    def listed(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._listed, F.count(F.lit(1)).alias("listed"))

    def read(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        return rows.observe(self._read, F.count(F.lit(1)).alias("read"), F.count_if(F.col(text_col).isNull()).alias("failed"))

    def counts(self) -> dict[str, int]:
        """listed, read (failed ones included), failed, and skipped: those never opened."""
        found = {"listed": 0, "read": 0, "failed": 0} | self._listed.get | self._read.get
        return found | {"skipped": found["listed"] - found["read"]}
