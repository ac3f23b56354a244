"""Tables as rows that all cores share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are worth a task of their own, and tasks a core.
ROWS, TASKS = 5_000, 4


def parts_for(rows: list[int], cores: int) -> int | None:
    """Partitions to deal rows out to, given the rows that each partition has; None where dealing would gain little."""
    total, most = sum(rows), max(rows, default=0)
    if most <= ROWS or 2 * most * cores <= 3 * total:  # the fullest has at most half as much again as a core's share
        return None
    return min(-(-total // ROWS), TASKS * cores)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table, dealt out evenly if its files are too few or too lopsided for the cores at hand.

    Spark cannot split a row group, and writers put a million rows into one: such a file is one task, however many cores
    there are. Rows a partition are counted without a column, that is from the files' footers.
    """
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    n = parts_for(rows, df.sparkSession.sparkContext.defaultParallelism)
    return df if n is None else df.repartition(n)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))
