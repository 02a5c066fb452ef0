"""Commit histories: per path and directory, authors, edit windows, incremental merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import DAY, days_since
from ..functions.paths import ancestors
from ..functions.tasks import dealt


def path_history(touches: DataFrame, now: Column, recent_days: int = 90) -> DataFrame:
    """``path, sha, seq, ts, author`` -> per path: commits, recent commits, oldest and newest time, last author and commit.

    The newest commit names the last author; of equally old ones the one seen first in a walk from the
    newest, that with the smallest sequence number.
    """
    recent = F.unix_timestamp("ts") >= F.unix_timestamp(now) - recent_days * DAY
    last = F.struct("ts", -F.col("seq"))
    return touches.groupBy("path").agg(
        F.count("*").alias("commits"),
        F.sum(recent.cast("long")).alias("recent"),
        F.min("ts").alias("oldest"),
        F.max("ts").alias("newest"),
        F.max_by("author", last).alias("last_author"),
        F.max_by("sha", last).alias("last_commit"),
    )


def with_dirs(commit_files: DataFrame, tasks: int | None = None) -> DataFrame:
    """``sha, path`` -> the same with every directory above each path; a commit counts once for each.

    ``tasks``: how many the commits are dealt to; the directories are told apart where the commit is.
    """
    return dealt(commit_files.select("sha", "path"), tasks, "sha").select("sha", F.explode(ancestors(F.col("path"), itself=True)).alias("path")).distinct()


def rank_authors(commits: DataFrame, keep: int = 1024) -> DataFrame:
    """Authors by commits, then name; the first ``keep``."""
    return commits.groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(keep)


def edit_windows(edits: DataFrame, key: str, ts: str, now: Column, windows: list[int]) -> DataFrame:
    """Edits per key within calendar-day windows: day > today - n, in UTC days."""
    day = F.floor(F.unix_timestamp(ts) / DAY)
    today = F.floor(F.unix_timestamp(now) / DAY)
    days = edits.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy(key).agg(*[F.sum(F.when(F.col("day") > today - w, F.col("n")).otherwise(0)).alias(f"w{k}") for k, w in enumerate(windows)])


def merge_history(banked: DataFrame, delta: DataFrame) -> DataFrame:
    """Two aggregates of ``path_history`` over disjoint commits, as one. The delta wins ties of time."""
    both = banked.withColumn("late", F.lit(0)).unionByName(delta.withColumn("late", F.lit(1)))
    last = F.struct("newest", "late")
    return both.groupBy("path").agg(
        F.sum("commits").alias("commits"), F.sum("recent").alias("recent"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        F.max_by("last_author", last).alias("last_author"), F.max_by("last_commit", last).alias("last_commit"),
    )


def replace_recent(bank: DataFrame, window: DataFrame) -> DataFrame:
    """The banked histories with the recent counts of a fresh walk; paths that it lacks have none."""
    fresh = window.select("path", F.col("recent").alias("fresh"))
    return bank.join(fresh, "path", "left").withColumn("recent", F.coalesce("fresh", F.lit(0))).drop("fresh")


def blame_ranges(functions: DataFrame, lines: DataFrame, now: Column, tasks: int | None = None) -> DataFrame:
    """Functions with the lines in ``start_line..end_line`` of their path: commits, ages, authors, headcount.

    The path is the equi-key of the range join. The newest line is the first with the latest time; the main
    author has the most lines, of equals the one who first appears last. Functions without lines stay, null.
    ``tasks``: how many the paths are dealt to; a function's lines are counted where its path is.
    """
    f = functions.select("key", "path", "start_line", "end_line")
    hit = dealt(f, tasks, "path").join(dealt(lines.select("path", "line_no", "commit", "author", "ts"), tasks, "path"), "path").where("line_no between start_line and end_line")
    people = hit.groupBy("path", "key", "author").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    main = people.groupBy("path", "key").agg(F.max_by("author", F.struct("n", "first")).alias("main_author"), F.count("*").alias("headcount"))
    own = hit.groupBy("path", "key").agg(
        F.countDistinct("commit").alias("commits"),
        F.max_by("author", F.struct("ts", -F.col("line_no"))).alias("last_author"),
        days_since(F.min("ts"), now).alias("age"),
        days_since(F.max("ts"), now).alias("touched"),
    )
    return f.select("key").join(own.drop("path"), "key", "left").join(main.drop("path"), "key", "left")


def headcounts(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per path: distinct authors (empty names do not count) and main author, as in ``blame_ranges``."""
    named = lines.select("path", "author", "line_no").where("author is not null and cast(author as string) <> ''")
    people = dealt(named, tasks, "path").groupBy("path", "author").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    return people.groupBy("path").agg(F.count("*").alias("headcount"), F.max_by("author", F.struct("n", "first")).alias("main_author"))


def contributors(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines per author and lines per commit of each path, most first."""
    by = lambda c: lines.groupBy("path", c).agg(F.count("*").alias("lines"))
    return by("author"), by("commit")


def with_file_fallback(functions: DataFrame, blamed: DataFrame, by_file: DataFrame) -> DataFrame:
    """Function ages from blame where its path was blamed at all, else all of them from the file's history."""
    paths = blamed.select("path").distinct().withColumn("has_blame", F.lit(True))
    f = functions.select("key", "path").join(paths, "path", "left")
    f = f.join(blamed.select("key", F.struct("age", "touched").alias("own")), "key", "left").join(by_file.select("path", F.struct("age", "touched").alias("file")), "path", "left")
    chosen = F.when(F.col("has_blame"), F.col("own")).otherwise(F.col("file"))
    return f.select("key", chosen["age"].alias("age"), chosen["touched"].alias("touched"))
