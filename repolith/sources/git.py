"""Git output as tables: logs, raw changes, line-porcelain blame, numstat.

The parsers take lines of text that git has printed, from files that Spark reads or from a repository on
the driver; git itself is never part of a distributed plan.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the log format that is asked for: a record, then time, author and hash.
RECORD, FIELD = "\x01", "\x02"
LOG_FORMAT = f"--format=%x01%ct%x02%an%x02%H"


def parse_log(text: DataFrame, column: str = "value") -> DataFrame:
    """Records of a log -> ``sha, ts (seconds), author, seq, path``: a row a commit and path; commits without paths have a null path.

    ``text`` has one record a row, as ``read_log`` gives it, with ``seq`` its place in the walk. A record
    without a hash is named by its place.
    """
    lines = F.split(F.regexp_replace(column, RECORD, ""), "\n")
    head = F.split(F.element_at(lines, 1), FIELD)
    paths = F.filter(F.slice(lines, 2, 1_000_000_000), lambda p: F.trim(p) != "")
    rows = text.where(F.length(F.trim(column)) > 0).select(
        F.coalesce(F.try_element_at(head, F.lit(3)), F.col("seq").cast("string")).alias("sha"), F.element_at(head, 1).cast("long").alias("ts"), F.try_element_at(head, F.lit(2)).alias("author"), "seq", F.explode_outer(paths).alias("path")
    )
    return rows.where("ts is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file cut at its record marks; ``seq`` is the place in the walk within each file."""
    return spark.read.option("lineSep", RECORD).text(path).withColumn("seq", F.monotonically_increasing_id())


CHANGE = r"^:(\d+) (\d+) (\S+) (\S+) ([A-Z])(\d*)\t([^\t]+)(?:\t(.+))?$"


def parse_raw(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw change lines -> ``op, path, retired``: added or modified paths, deletions, renames with what they retire, copies."""
    g = lambda k: F.regexp_extract(column, CHANGE, k)
    rows = lines.where(F.col(column).rlike(CHANGE)).select("*", g(5).alias("status"), g(7).alias("first"), g(8).alias("second"))
    op = F.when(F.col("status") == "D", "delete").when(F.col("status").isin("A", "R", "C"), "add").otherwise("modify")
    path = F.when(F.col("second") != "", F.col("second")).otherwise(F.col("first"))
    retired = F.when(F.col("status") == "R", F.col("first"))
    return rows.withColumns({"op": op, "path": path, "retired": retired}).drop("status", "first", "second")


def parse_porcelain(path: str, text: str) -> Iterator[tuple[str, int, str, str | None, int | None]]:
    """Line-porcelain blame -> (path, line, commit, author, time). Attributes may be given once a commit."""
    known: dict[str, dict[str, str]] = {}
    commit, line = "", 0
    for row in text.split("\n"):
        if row.startswith("\t"):
            told = known.get(commit, {})
            time = told.get("author-time")
            yield path, line, commit, told.get("author"), int(time) if time else None
        elif m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
            known.setdefault(commit, {})
        elif commit and row:
            name, _, value = row.partition(" ")
            known[commit][name] = value


def blame_lines(porcelain: DataFrame) -> DataFrame:
    """``path, text`` (one blamed file a row) -> ``path, line_no, commit, author, ts``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "line_no", "commit", "author", "ts"]
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                out = pd.DataFrame(list(parse_porcelain(path, text or "")), columns=columns)
                yield out.astype({"line_no": "int64", "ts": "Int64"})

    return porcelain.select("path", "text").mapInPandas(run, "path string, line_no long, commit string, author string, ts long")


def numstat(lines: DataFrame, column: str = "value") -> DataFrame:
    """Numstat lines -> ``path, added, removed``; binary files count as none."""
    parts = F.split(column, "\t")
    n = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("long"), F.lit(0))
    return lines.where(F.size(parts) == 3).select(F.element_at(parts, 3).alias("path"), n(1).alias("added"), n(2).alias("removed"))


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def repository_log(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """The log of a repository on the driver: ``sha, ts, author, seq, path``; with ``since`` only commits after it."""
    text = git(repo, "log", LOG_FORMAT, "--name-only", *([f"{since}..HEAD"] if since else []))
    records = [(r, k) for k, r in enumerate(text.split(RECORD)) if r.strip()]
    return parse_log(spark.createDataFrame(records, "value string, seq long"))


def repository_blame(spark: SparkSession, repo: str, paths: list[str]) -> DataFrame:
    return blame_lines(spark.createDataFrame([(p, git(repo, "blame", "--line-porcelain", "--", p)) for p in paths], "path string, text string"))


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse_hunks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Hunk heads of a diff without context -> ``old_start, old_lines, new_start, new_lines`` beside the other columns."""
    g = lambda k: F.regexp_extract(column, HUNK, k)
    n = lambda k: F.when(g(k) == "", F.lit(1)).otherwise(g(k).try_cast("long")).cast("long")
    return lines.where(F.col(column).rlike(HUNK)).withColumns({"old_start": n(1), "old_lines": n(2), "new_start": n(3), "new_lines": n(4)}).drop(column)
