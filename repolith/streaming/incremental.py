"""Histories and readings that arrive in batches: each is merged into what is stored.

A merge reads the stored table and writes the next version beside it, then names it current; a batch that
is delivered twice is recognised by its number and left out, so restarts neither lose nor repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import merge_history, path_history

KEEP = 2


class VersionedTable:
    """A table as numbered folders under a path; version n is the state after batch n."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self.fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self.fs.exists(self._at(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def update(self, batch: int, change: Callable[[DataFrame | None], DataFrame]) -> None:
        found = self.versions()
        if found and found[-1] >= batch:
            return
        change(self.read()).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        for old in self.versions()[:-KEEP]:
            self.fs.delete(self._at(f"v{old}"), True)


def stream_history(touches: DataFrame, table: VersionedTable, now: Column, checkpoint: str, recent_days: int = 90) -> StreamingQuery:
    """Per-path histories of a stream of commits; the work of a batch is in proportion to it and the table."""

    def merge(batch: DataFrame, number: int) -> None:
        delta = path_history(batch, now, recent_days)
        table.update(number, lambda stored: delta if stored is None else merge_history(stored, delta))

    return touches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stored: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, by ``order``; of equals that of the batch."""
    late = batch.withColumn("late", F.lit(1))
    both = late if stored is None else stored.withColumn("late", F.lit(0)).unionByName(late)
    columns = [c for c in both.columns if c not in (key, "late")]
    last = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "late")).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in columns])


def stream_readings(readings: DataFrame, table: VersionedTable, checkpoint: str, key: str = "reading_id", order: str = "arrived") -> StreamingQuery:
    """Readings as they arrive, one row a key."""
    return readings.writeStream.foreachBatch(lambda batch, n: table.update(n, lambda stored: upsert(stored, batch, key, order))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
