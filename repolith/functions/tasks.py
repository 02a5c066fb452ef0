"""How many tasks rows are dealt to, so that what a task holds does not grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task of a large table, and the fewest that are worth a task of their own.
MOST_ROWS, FEWEST_ROWS = 250_000, 20_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many as the session shuffles to where that suffices, fewer for few rows, and more than that for many."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, rows // FEWEST_ROWS), -(-rows // MOST_ROWS))


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """Dealt by columns to so many tasks, which the adaptive planner then leaves as they are; without a number, as it came."""
    return df.repartition(tasks, *by) if tasks else df
