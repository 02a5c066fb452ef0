"""What has changed in a tree since it was last looked at: manifests of its files compared with the present listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import VersionedTable

ADDED, CHANGED, GONE = "added", "changed", "gone"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, size, time`` of the files under a folder, as Spark lists them; no file is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("time"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, op`` of what was added, changed (another size or time) or is gone; paths are unique on either side."""
    a, b = (df.select("path", F.struct("size", "time").alias(n)) for df, n in ((before, "was"), (now, "is")))
    op = F.when(F.col("was").isNull(), ADDED).when(F.col("is").isNull(), GONE).when(~F.col("was").eqNullSafe(F.col("is")), CHANGED)
    return a.join(b, "path", "full").select("path", op.alias("op")).where("op is not null")


def mark(files: DataFrame) -> DataFrame:
    """One row that says whether anything moved: equal listings have equal marks, in whatever order they come."""
    of = F.xxhash64("path", "size", "time").cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(of), F.lit(0).cast("decimal(38,0)")).alias("sum"))


def look(table: VersionedTable, number: int, now: DataFrame) -> DataFrame | None:
    """The changes since the last look, whose manifest is kept by version; everything at the first, None for a look that was taken before.

    The manifest of this look is stored first and compared as it was stored, so changes that happen meanwhile are
    those of the next.
    """
    if number in table.versions():
        return None
    before = table.read()
    table.update(number, lambda _: now)
    stored = table.read()
    return changes(before if before is not None else stored.limit(0), stored)
