"""How often a body was rewritten, whatever of it survives: a change of its digest is an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .history import DAY, edit_windows


def edits(versions: DataFrame, key: tuple[str, ...] = ("key",)) -> DataFrame:
    """``key, idx, ts, digest`` (null where the body is gone) -> the versions that are edits.

    The first version of a body is one, and so is each whose digest differs from that of the version before, the
    first after it was gone included; going is none, and neither is a commit that leaves the body as it was.
    """
    before = F.lag("digest").over(Window.partitionBy(*key).orderBy("idx"))
    return versions.withColumn("before", before).where(F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("before"))).drop("before")


def edit_counts(versions: DataFrame, now: Column, windows: list[int]) -> DataFrame:
    """``key, w0, w1, ...``: edits within each window of calendar days; keys without versions are absent."""
    return edit_windows(edits(versions), "key", "ts", now, windows)


def file_edits(versions: DataFrame) -> DataFrame:
    """``path, idx, ts`` of the commits that edited any body of a file (``path`` beside the columns of ``edits``)."""
    return edits(versions).select("path", "idx", "ts").distinct()


def commit_counts(versions: DataFrame, now: Column, days: int, key: tuple[str, ...] = ("key",), at: str = "path") -> tuple[DataFrame, DataFrame]:
    """Commits that edited each key, and each path, within so many days: what the facts call ``commits``.

    Read twice, so the edits are stored once. ``key`` and ``at`` name the columns that tell bodies and files apart.
    """
    found = stored(edits(versions, key).select(*dict.fromkeys([*key, at, "idx", "ts"])))
    recent = F.floor(F.unix_timestamp("ts") / DAY) > F.floor(F.unix_timestamp(now) / DAY) - days
    commits = F.sum(F.when(recent, 1).otherwise(0)).alias("commits")
    return found.groupBy(*key).agg(commits), found.select(at, "idx", "ts").distinct().groupBy(at).agg(commits)
