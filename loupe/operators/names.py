"""Names found by the three-letter pieces they hold, instead of a scan of all names.

Names are stored in their order and dealt into blocks; the pieces of each are rows (gram, block, id), stored by gram.  What a
query must hold literally gives pieces; ids that have them all are candidates, whose blocks alone are read and whose
names are then tested.  A query without three letters in a row scans all names, with the same result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import name_matches

#: Names of a block, and blocks that are named to the scan one by one; more are joined.
BLOCK_NAMES, LISTED_BLOCKS = 4096, 4096
_ROW_GROUP = 4 << 20


def grams_of(query: str) -> list[str]:
    """The three-letter pieces that every matching name holds."""
    runs = [run for part in query.lower().split() for run in re.split(r"[*?]+", part)]
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


class NameIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, names: DataFrame, id_col: str = "id", name_col: str = "name", files: int | None = None) -> None:
        """Writes names (ids are unique) and their pieces; a null name is found by no query but an empty one."""
        low = F.lower(F.coalesce(F.col(name_col), F.lit("")))
        rows = names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), low.alias("name_lower"))
        dealt = rows.repartitionByRange(*([files] if files else []), "name_lower").sortWithinPartitions("name_lower")
        place = F.monotonically_increasing_id()  # the partition's number, and 33 bits of the row's place in it
        within = F.floor(place.bitwiseAND((1 << 33) - 1) / BLOCK_NAMES)
        numbered = dealt.withColumn("block", F.shiftleft(F.shiftright(place, 33), 22) + within)
        numbered.write.mode("overwrite").option("parquet.block.size", _ROW_GROUP).parquet(f"{self.path}/names")
        held = self.names().where("length(name_lower) >= 3")
        pieces = held.select("block", "id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name_lower") - 2), lambda i: F.substring("name_lower", i, F.lit(3))))).alias("gram"))
        pieces.select("gram", "block", "id").repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option("parquet.block.size", _ROW_GROUP).parquet(f"{self.path}/grams")

    def names(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/names")

    def candidates(self, grams: list[str]) -> DataFrame:
        """id and block of the names that hold all pieces."""
        rows = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(grams))
        return rows.groupBy("id", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id", "block")

    def search(self, query: str) -> DataFrame:
        """id and name of the names that ``name_matches`` accepts."""
        grams, names = grams_of(query), self.names()
        if grams:
            found = self.candidates(grams)
            blocks = [r[0] for r in found.select("block").distinct().limit(LISTED_BLOCKS + 1).collect()]
            names = names.where(F.col("block").isin(blocks)) if len(blocks) <= LISTED_BLOCKS else names
            names = names.join(found.select("id", "block"), ["id", "block"], "left_semi")
        return names.where(name_matches(query, F.col("name_lower"))).select("id", "name")
