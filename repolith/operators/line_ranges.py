"""The history of a range of lines: intervals carried backwards through the hunks of a file's commits.

Each commit maps its version's lines to those of the version before: a line outside all hunks moves by what the hunks
before it added and removed, and a range that meets a hunk takes in the lines that the hunk replaced. A range whose
lines were all added by a commit began there.

A file's commits follow one another, so they are read in their order; files are dealt over the cluster, and a task
holds a fixed number of rows, one commit's hunks and the ranges asked of one file, whatever the length of the file's
history. The files of these rows go back side by side, a commit of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASKED, HUNK = 0, 1
TOUCHED = "file string, ask string, idx long, start long, end long, added long, removed long, began boolean"
NAMES = [c.split(" ")[0] for c in TOUCHED.split(", ")]
#: Rows whose files go back together, and rows of the history that leave a task at a time.
TOGETHER, TOLD = 200_000, 50_000


class Commits:
    """Hunks (old start, old lines, new start, new lines) of many commits, in the order of commit and line."""

    def __init__(self, hunks: np.ndarray, first: np.ndarray):
        self.old, self.old_n, self.new, self.new_n = hunks
        self.first, self.end = first, np.r_[first[1:], len(self.old)].astype(np.int64)
        # where a hunk has no lines on a side, its start there is the line that it stands behind
        self.last = np.where(self.new_n > 0, self.new + self.new_n - 1, self.new)
        self.moved, self.added, self.removed = (np.r_[0, np.cumsum(x)] for x in (self.old_n - self.new_n, self.new_n, self.old_n))
        self.lines = np.unique(self.last)
        self.places = np.repeat(np.arange(len(first)), self.end - first) * (len(self.lines) + 1) + np.searchsorted(self.lines, self.last)

    def behind(self, commit: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The first hunk of a commit that does not end before a line."""
        return np.searchsorted(self.places, commit * (len(self.lines) + 1) + np.searchsorted(self.lines, line))

    def step_back(self, commit: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ranges before the commit that each is at, and what of it met them.

        Gives the new starts and ends (a range that began here ends before it starts), whether it was met, and the lines
        added and removed in it.
        """
        take = lambda of, at: np.take(of, at, mode="clip")
        first, stop = self.first[commit], self.end[commit]
        at_start, at_end = self.behind(commit, start), self.behind(commit, end)
        inside = lambda at, line: (at < stop) & (take(self.new_n, at) > 0) & (take(self.new, at) <= line)
        in_start, in_end = inside(at_start, start), inside(at_end, end)
        moved = lambda at: self.moved[at] - self.moved[first]
        back_start = np.where(in_start, take(self.old, at_start) + (take(self.old_n, at_start) == 0), start + moved(at_start))
        back_end = np.where(in_end, take(self.old, at_end) + take(self.old_n, at_end) - (take(self.old_n, at_end) > 0), end + moved(at_end))
        until = at_end + in_end
        more = self.added[until] - self.added[at_start]
        more = more - np.where(in_start, start - take(self.new, at_start), 0) - np.where(in_end, take(self.last, at_end) - end, 0)
        return back_start, back_end, until > at_start, more, self.removed[until] - self.removed[at_start]


def step_back(start: np.ndarray, end: np.ndarray, hunks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges before one commit with these hunks, a row each; see ``Commits.step_back``."""
    return Commits(hunks.T, np.zeros(1, np.int64)).step_back(np.zeros(len(start), np.int64), start, end)


def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of file, kind, newest commit and line: ranges first, then hunks.

    The files of some rows go back together, each by a commit of its own a step. Of the last file, which may go on in the
    next rows, the ranges are kept, and the rows of its last commit.
    """
    held: list[pa.RecordBatch] = []
    #: the file that was last and its ranges: names, starts and ends
    left: tuple[str | None, pa.Array, np.ndarray, np.ndarray] = (None, pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def back(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal left
        file, kind, idx, ask, *lines = (c.combine_chunks() for c in table.columns)
        if any(c.null_count for c in lines):
            raise ValueError("a hunk or a range without its lines")
        kind, idx, *lines = (c.to_numpy() for c in (kind, idx, *lines))
        moved = file_moves(file)
        number = np.r_[0, np.cumsum(moved)]
        heads = np.r_[0, np.flatnonzero(moved) + 1]
        asked, hunk = np.flatnonzero(kind == ASKED), np.flatnonzero(kind == HUNK)
        names, of, start, end = ask.take(pa.array(asked)), number[asked], lines[0][asked], lines[1][asked]
        if left[0] == file[0].as_py():
            names = pa.concat_arrays([left[1], names])
            of, start, end = np.r_[np.zeros(len(left[2]), np.int64), of], np.r_[left[2], start], np.r_[left[3], end]
        fresh = np.r_[True, (number[hunk][1:] != number[hunk][:-1]) | (idx[hunk][1:] != idx[hunk][:-1])] if len(hunk) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        commits = Commits(np.array([x[hunk] for x in lines]), first)
        seq, whose = idx[hunk][first], number[hunk][first]
        at, until = np.searchsorted(whose, np.arange(len(heads))), np.searchsorted(whose, np.arange(len(heads)), "right")
        who, step, out, many = np.arange(len(of)), 0, [], 0

        def told() -> pa.RecordBatch:
            rows, *more = (np.concatenate(x) for x in zip(*out, strict=True))
            columns = [file.take(pa.array(heads[of[rows]])), names.take(pa.array(rows)), *map(pa.array, more)]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        while len(who := who[at[of[who]] + step < until[of[who]]]):
            commit = at[of[who]] + step
            back_start, back_end, met, added, removed = commits.step_back(commit, start[who], end[who])
            began = back_start > back_end
            out.append((who[met], seq[commit[met]], start[who[met]], end[who[met]], added[met], removed[met], began[met]))
            many += int(met.sum())
            start[who], end[who] = back_start, back_end
            # most commits of a file lie behind the ranges' beginnings
            who, step = who[~began], step + 1
            if many >= TOLD:
                yield told()
                out, many = [], 0
        if many:
            yield told()
        stay = np.flatnonzero((of == len(heads) - 1) & (start <= end))
        left = (file[-1].as_py(), names.take(pa.array(stay)), start[stay], end[stay])

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held)
        upto = len(table)
        if not last:
            # a commit may go on in the next batch
            number, idx = np.r_[0, np.cumsum(file_moves(table.column(0).combine_chunks()))], table.column(2).to_numpy()
            ends = np.flatnonzero((number[1:] != number[:-1]) | (idx[1:] != idx[:-1]))
            upto = int(ends[-1]) + 1 if len(ends) else 0
        if upto:
            yield from back(table.slice(0, upto))
        held = table.slice(upto).combine_chunks().to_batches()

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            yield from whole(False)
    if held:
        yield from whole(True)


def file_moves(file: pa.Array) -> np.ndarray:
    """Whether each row but the first is of another file than the one before."""
    code = file.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return code[1:] != code[:-1]


def range_history(asked: DataFrame, hunks: DataFrame) -> DataFrame:
    """``file, ask, idx, start, end, added, removed, began``: each commit that met a range, with the range as it was then.

    ``asked``: file, ask (a name, unique within its file), start, end, in the newest version. ``hunks``: file, idx, old_start,
    old_lines, new_start, new_lines, as a diff without context tells them. ``file`` names a file over its renames (its origin,
    see ``lineage.with_origin``). ``began``: all lines of the range came with this commit. Empty ranges have no history.
    """
    zero = F.lit(0).cast("long")
    ranges = asked.where("start <= end").select(F.col("file").cast("string").alias("file"), F.lit(ASKED).alias("kind"), F.lit((1 << 62)).cast("long").alias("idx"), F.col("ask").cast("string").alias("ask"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), zero.alias("c"), zero.alias("d"))
    told = hunks.select(F.col("file").cast("string").alias("file"), F.lit(HUNK).alias("kind"), F.col("idx").cast("long").alias("idx"), F.lit(None).cast("string").alias("ask"), *[F.col(c).cast("long").alias(n) for c, n in zip(("old_start", "old_lines", "new_start", "new_lines"), "abcd", strict=True)])
    # files that nobody asks of stay where they are
    told = told.join(ranges.select("file").distinct(), "file", "left_semi")
    # by number, as small rows that take long would be put together by their bytes
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranges.unionByName(told.select(ranges.columns)).repartition(parts, "file").sortWithinPartitions("file", "kind", F.desc("idx"), "c", "a")
    return rows.mapInArrow(carry, TOUCHED)


def surviving(history: DataFrame, lines: DataFrame, asked: DataFrame) -> DataFrame:
    """The history with how many lines of the range each commit still has: ``lines``: file, line_no, idx (as blamed)."""
    r = asked.select(F.col("file").cast("string").alias("file"), F.col("ask").cast("string").alias("ask"), F.col("start").alias("low"), F.col("end").alias("high"))
    now = lines.select(F.col("file").cast("string").alias("file"), "line_no", "idx").join(r, "file").where("line_no between low and high").groupBy("file", "ask", "idx").agg(F.count("*").alias("lines"))
    return history.join(now, ["file", "ask", "idx"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
