"""Pages of a large ordered result, read at any depth without sorting or skipping all before them.

The rows are written once by ranges of the order, each with its place in its range. Counts per
range and their prefix sum tell which ranges hold a page; only those are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.session import work_path

#: Rows of a range, about.
RANGE_ROWS = 1_000_000
#: So many ranges may be smaller than that: the driver samples the order, and lists files, by range.
MOST_RANGES = 256


@dataclass(frozen=True)
class PagedTable:
    """Rows by range, and (range, first, rows) of every range that has some."""

    spark: SparkSession
    path: str
    schema: StructType
    starts: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return sum(rows for _, _, rows in self.starts)

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows from ``offset`` on, at most ``limit``, with their ``place`` from 1."""
        held = {number: first for number, first, rows in self.starts if first < offset + limit and first + rows > offset}
        rows = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("_range").isin(sorted(held) or [-1]))
        first = F.lit(0)
        for number, start in held.items():  # the ranges of one page
            first = F.when(F.col("_range") == number, F.lit(start)).otherwise(first)
        placed = rows.withColumn("place", first + F.col("_nr") + 1)
        return placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).drop("_range", "_nr").orderBy("place")


def paged(df: DataFrame, order: list[Column | str], range_rows: int = RANGE_ROWS, label: str = "pages") -> PagedTable:
    """Orders and writes a result for paging; ``order`` should leave no ties.

    Smaller ranges than ``RANGE_ROWS`` grow with the result once there are ``MOST_RANGES`` of them.
    """
    spark = df.sparkSession
    total = df.count()
    ranges = max(1, min(-(-total // range_rows), max(MOST_RANGES, -(-total // RANGE_ROWS))))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The lower 33 bits of the running id are a row's place in its partition.
    placed = ordered.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nr"))
    path = work_path(spark, label)
    placed.write.partitionBy("_range").parquet(path)
    counts = spark.read.schema(placed.schema).parquet(path).groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    starts, first = [], 0
    for row in counts.orderBy("_range").toLocalIterator():  # a row per range
        starts.append((row["_range"], first, row["n"]))
        first += row["n"]
    return PagedTable(spark, path, placed.schema, tuple(starts))
