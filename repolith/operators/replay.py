"""Histories as of any commit: every change carries its index, so a state is an aggregate, not a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import days_since
from ..functions.paths import ancestors

RING = 16


def as_of(deltas: DataFrame, idx: int, *values: str) -> DataFrame:
    """``func_id`` with the values of its last change up to the index, where that was no deletion."""
    values = values or ("path", "loc")
    last = F.max_by(F.struct("op", *values), "idx").alias("x")
    return deltas.where(F.col("idx") <= idx).groupBy("func_id").agg(last).where("x.op = 'set'").select("func_id", *[F.col(f"x.{v}").alias(v) for v in values])


def live_dirs(deltas: DataFrame, idx: int) -> DataFrame:
    """Directories with live functions as of the index: files, functions and lines below each."""
    files = as_of(deltas, idx).groupBy("path").agg(F.count("*").alias("functions"), F.sum("loc").alias("lines"))
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir"), "functions", "lines").groupBy("dir").agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("lines").alias("lines"))


def churn_ring(deltas: DataFrame, idx: int, at: Column, windows: tuple[int, ...] = (30, 60, 90, 180), ring: int = RING) -> DataFrame:
    """Edits of each function within so many fractional days, of its last ``ring`` edits up to the index."""
    w = Window.partitionBy("func_id").orderBy(F.desc("idx"))
    recent = deltas.where(F.col("idx") <= idx).withColumn("k", F.row_number().over(w)).where(F.col("k") <= ring)
    age = days_since(F.col("ts"), at)
    return recent.groupBy("func_id").agg(*[F.sum((age <= d).cast("long")).alias(f"d{d}") for d in windows])


def born_at(deltas: DataFrame, idx: int) -> DataFrame:
    """``func_id, born``: the last change up to the index at which a function went from dead to live."""
    w = Window.partitionBy("func_id").orderBy("idx")
    d = deltas.where(F.col("idx") <= idx).withColumn("before", F.lag("op").over(w))
    return d.groupBy("func_id").agg(F.max(F.when((F.col("op") == "set") & ((F.col("before") == "del") | F.col("before").isNull()), F.col("idx"))).alias("born")).where("born is not null")


def fold(deltas: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """The state before the cut and the changes from it on; replaying both gives what all changes give."""
    base = as_of(deltas, cut - 1, "idx", "ts", "path", "loc").withColumn("op", F.lit("set"))
    return base, deltas.where(F.col("idx") >= cut)


def refold(base: DataFrame, later: DataFrame, idx: int) -> DataFrame:
    columns = ["func_id", "idx", "ts", "path", "loc", "op"]
    return as_of(base.select(*columns).unionByName(later.select(*columns)), idx)


def commit_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Function sets (``path, func_id, body_hash, loc``) of two versions -> ``set`` for new or changed, ``del`` for gone."""
    a, b = before.select("func_id", F.col("body_hash").alias("old")), after.select("func_id", F.col("body_hash").alias("new"), "path", "loc")
    both = a.join(b, "func_id", "full_outer")
    op = F.when(F.col("new").isNull(), "del").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "set")
    return both.select("func_id", op.alias("op"), "path", "loc").where("op is not null")


def statistics(deltas: DataFrame) -> DataFrame:
    """One row: functions ever, alive at the end, live lines, and the most alive at once.

    Changes of the count are summed per commit first; the running sum is over commits.
    """
    w = Window.partitionBy("func_id").orderBy("idx")
    live = (F.col("op") == "set").cast("long")
    d = deltas.withColumn("step", live - F.coalesce(F.lag(live).over(w), F.lit(0)))
    per = d.groupBy("idx").agg(F.sum("step").alias("step"))
    # the running total in two levels: within runs of indices, and over the runs
    run = F.floor(F.col("idx") / 4096)
    per = per.withColumn("run", run)
    runs = per.groupBy("run").agg(F.sum("step").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    peak = per.join(runs, "run").withColumn("alive", F.col("before") + F.sum("step").over(Window.partitionBy("run").orderBy("idx"))).agg(F.max("alive").alias("peak"))
    last = d.groupBy("func_id").agg(F.max_by(F.struct("op", "loc"), "idx").alias("x"))
    ends = last.agg(F.count("*").alias("ever"), F.sum((F.col("x.op") == "set").cast("long")).alias("alive"), F.sum(F.when(F.col("x.op") == "set", F.col("x.loc"))).alias("lines"))
    return ends.crossJoin(peak)


def busiest(deltas: DataFrame, most: int = 8) -> DataFrame:
    return deltas.groupBy("idx").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "idx").limit(most)


def as_of_join(asked: DataFrame, events: DataFrame, key: str, *values: str) -> DataFrame:
    """``asked`` (key, idx, ...) with the values that the key's last event had up to that index; null before the first.

    Both sides go through one shuffle by key and one sort, and the last event is carried forward; no pair of an
    asked row and an event is made. ``events``: key, idx and the values, one a key and index.
    """
    value = F.struct(*values)
    row = F.struct(*[F.col(c) for c in asked.columns])
    kind = asked.select(row).schema[0].dataType
    told = events.select(F.col(key).alias("k"), F.col("idx").alias("i"), F.lit(0).alias("late"), value.alias("v"), F.lit(None).cast(kind).alias("r"))
    ask = asked.select(F.col(key).alias("k"), F.col("idx").alias("i"), F.lit(1).alias("late"), F.lit(None).cast(told.schema["v"].dataType).alias("v"), row.alias("r"))
    by = Window.partitionBy("k").orderBy("i", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = told.unionByName(ask).withColumn("v", F.last("v", ignorenulls=True).over(by)).where("r is not null")
    return out.select("r.*", *[F.col(f"v.{v}").alias(v) for v in values])


#: Most checkpoints of a replay, and the fewest indices between two.
MOST_CHECKPOINTS, LEAST_SPACING = 12, 2000


def spacing(first: int, last: int, most: int = MOST_CHECKPOINTS, least: int = LEAST_SPACING) -> int:
    """Indices from one checkpoint to the next."""
    return max(least, -(-(last - first + 1) // most))


def write_frames(deltas: DataFrame, folder: str, every: int) -> None:
    """Stores changes for seeking: a snapshot at the start of every run of indices, and the changes of the run.

    ``folder/states/run=k`` holds the live functions before run k, ``folder/tails/run=k`` its changes. All snapshots
    come of one pass: the last change of each function a run, carried forward over the runs that have a snapshot.
    """
    run = F.floor(F.col("idx") / every).cast("long")
    columns = ["func_id", "idx", "op", "path", "loc"]
    deltas.select(*columns, run.alias("run")).repartition("run").write.partitionBy("run").mode("overwrite").parquet(f"{folder}/tails")
    last = deltas.select(*columns).groupBy("func_id", run.alias("run")).agg(F.max_by(F.struct(*columns[1:]), "idx").alias("x"))
    # a change lasts until the run of the function's next
    ends = F.lead("run").over(Window.partitionBy("func_id").orderBy("run"))
    top = deltas.agg(F.max(run).alias("top"))
    spans = last.withColumn("until", ends).crossJoin(F.broadcast(top)).withColumn("until", F.coalesce("until", "top"))
    spans = spans.where((F.col("until") > F.col("run")) & (F.col("x.op") == "set"))
    states = spans.select("func_id", "x.*", F.explode(F.sequence(F.col("run") + 1, F.col("until"))).alias("run"))
    states.repartition("run", "func_id").write.partitionBy("run").mode("overwrite").parquet(f"{folder}/states")


def read_frame(spark: SparkSession, folder: str, idx: int, every: int) -> DataFrame:
    """``func_id, path, loc`` as of the index: one snapshot and one run's changes are read, whatever was stored."""
    run = idx // every
    schema = "func_id string, idx long, op string, path string, loc long, run long"
    part = lambda what: spark.read.schema(schema).parquet(f"{folder}/{what}").where(F.col("run") == run)
    tail = part("tails").where(F.col("idx") <= idx)
    return as_of(part("states").unionByName(tail), idx)
