"""Readings: tallies, verification, the reading queue, peers and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import GRADES

STALE_BONUS, DATED_MALUS, FLAGGED_BONUS = 2.0, -1.0, 1.0
BATCH, PEERS = 10, 20
KIND_RANK = {"func": 2, "file": 1, "dir": 0}


def tally(readings: DataFrame, *by: str) -> DataFrame:
    """Counts of each grade on three axes, with ungraded, traps, surprised and derivable, per group."""
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sums = [one(F.col(axis) == g).alias(f"{axis}_{g}") for axis in ("predicted", "documented", "legible") for g in GRADES]
    sums += [one(F.col(axis).isNull()).alias(f"{axis}_ungraded") for axis in ("predicted", "documented", "legible")]
    return readings.groupBy(*by).agg(F.count("*").alias("readings"), *sums, one(F.col("trap")).alias("traps"), one(F.col("surprised")).alias("surprised"), one(F.col("derivable")).alias("derivable"), one(F.col("stale")).alias("stale"))


def tally_sets(readings: DataFrame) -> DataFrame:
    """Readings by model and by position in one pass (grouping sets); ``by`` says which."""
    g = readings.groupingSets([["model"], ["position"]], "model", "position").agg(F.count("*").alias("readings"), F.sum(F.col("trap").cast("long")).alias("traps"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "model").otherwise("position").alias("by"), F.coalesce("model", F.col("position").cast("string")).alias("value"), "readings", "traps")


def instrument(readings: DataFrame) -> DataFrame:
    """One row: the only model, or null where several are mixed, and how many there are."""
    return readings.agg(F.when(F.countDistinct("model") == 1, F.min("model")).alias("model"), F.countDistinct("model").alias("models"), F.count("*").alias("readings"))


def outstanding(subjects: DataFrame, readings: DataFrame) -> DataFrame:
    """``id, why``: subjects without a reading (unread) or with a stale one."""
    r = readings.select(F.col("reading_id").alias("id"), "stale")
    unread = subjects.join(r, "id", "left_anti").select("id", F.lit("unread").alias("why"))
    stale = subjects.join(r.where("stale"), "id", "left_semi").select("id", F.lit("stale").alias("why"))
    return unread.unionByName(stale)


def verify(subjects: DataFrame, readings: DataFrame) -> DataFrame:
    """One row: subjects, unread, stale, instruments and the exit code: 0 complete, 1 outstanding, 2 mixed instruments."""
    known = readings.join(subjects.select(F.col("id").alias("reading_id")), "reading_id", "left_semi")
    left = outstanding(subjects, readings).agg(F.sum((F.col("why") == "unread").cast("long")).alias("unread"), F.sum((F.col("why") == "stale").cast("long")).alias("stale"))
    tools = known.where("not stale").agg(F.countDistinct("model").alias("instruments"))
    n = subjects.agg(F.count("*").alias("subjects"))
    # three tables of one row each
    one = n.crossJoin(left).crossJoin(tools)
    unread, stale = F.coalesce("unread", F.lit(0)), F.coalesce("stale", F.lit(0))
    return one.select("subjects", unread.alias("unread"), stale.alias("stale"), "instruments", F.when(unread + stale > 0, 1).when(F.col("instruments") > 1, 2).otherwise(0).alias("exit_code"))


def queue_priority(proxy: Column, stale: Column, dated: Column, flagged: Column) -> Column:
    """Stale before flagged before unread before dated, the more surprising first in each."""
    bonus = F.when(stale, STALE_BONUS).when(dated, DATED_MALUS).when(flagged, FLAGGED_BONUS).otherwise(0.0)
    return F.coalesce(proxy, F.lit(0.5)) + bonus


def round_robin(tasks: DataFrame, n: int) -> DataFrame:
    """``id, path, priority`` -> the first ``n`` in reading order, one of each file a round.

    Files take turns in the order of their best task. Columns ``turn`` and ``place`` say where.
    """
    w = Window.partitionBy("path").orderBy(F.desc("priority"), "id")
    best = F.max(F.struct(F.col("priority"), F.lit(0))).over(Window.partitionBy("path"))["priority"]
    first = F.first("id").over(w)
    t = tasks.withColumn("turn", F.row_number().over(w)).withColumn("best", best).withColumn("first", first)
    # a task past the n-th of its file or in a file past the n-th cannot be among the first n
    t = t.where(F.col("turn") <= n).orderBy("turn", F.desc("best"), "first").limit(n)
    return t.withColumn("place", F.row_number().over(Window.orderBy("turn", F.desc("best"), "first"))).drop("best", "first")


def reading_curve(tasks: DataFrame, batch: int = BATCH) -> DataFrame:
    """``pos, lines`` -> cumulative lines at the end of each batch of tasks.

    Sums per batch come first, so what is ordered on one task is a row a batch.
    """
    per = tasks.groupBy(F.floor((F.col("pos") - 1) / batch).alias("batch")).agg(F.max("pos").alias("pos"), F.sum("lines").alias("lines"))
    return per.select("batch", "pos", F.sum("lines").over(Window.orderBy("batch")).alias("cumulative"))


def peer_windows(subjects: DataFrame, most: int = PEERS) -> DataFrame:
    """``path, id, pos`` (source order in the file) -> for each subject the span of its peers and how many are left out."""
    n = F.count("*").over(Window.partitionBy("path"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("pos", "id"))
    s = subjects.withColumn("n", n).withColumn("place", place)
    start = F.greatest(F.lit(1), F.least(F.col("place") - most // 2, F.col("n") - most))
    end = F.least(F.col("n"), start + most)
    return s.select("id", "path", start.alias("from_place"), end.alias("to_place"), (F.col("n") - 1 - (end - start)).alias("omitted"))


def search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """``kind, name, path, line, loc`` ranked: exact or stem, prefix, inside the name, inside the path; functions first."""
    needle = query.strip().lower()
    if len(needle.encode()) < 2:
        return nodes.limit(0).withColumn("tier", F.lit(0))
    name = F.lower("name")
    stem = F.when((F.col("kind") == "file") & (F.instr(name, ".") > 0), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    base = F.when((name == needle) | (stem == needle), 30).when(name.startswith(needle), 20).when(name.contains(needle), 10).when(F.lower("path").contains(needle), 0)
    kind = F.lit(0)
    for k, v in KIND_RANK.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    rows = nodes.where(~F.coalesce(F.col("excluded"), F.lit(False))) if "excluded" in nodes.columns else nodes
    hit = rows.withColumn("tier", (base + kind).cast("int")).where("tier is not null")
    return hit.orderBy(F.desc("tier"), F.desc("loc"), "path", "line", "name").limit(limit)


def category_cap(rows: DataFrame, column: str, lines: str, most: int) -> DataFrame:
    """Legend rows: the largest categories by lines, the others as one, the order they are shown in."""
    sums = rows.groupBy(column).agg(F.sum(lines).alias("lines"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("lines"), column))
    named = sums.where(F.col(column).isNotNull()).withColumn("place", place)
    capped = named.select(F.when(F.col("place") <= most, F.col(column)).otherwise("other").alias("category"), F.least("place", F.lit(most + 1)).alias("place"), "lines", "n")
    unknown = sums.where(F.col(column).isNull()).select(F.lit("unknown").alias("category"), F.lit(most + 2).alias("place"), "lines", "n")
    return capped.unionByName(unknown).groupBy("category", "place").agg(F.sum("lines").alias("lines"), F.sum("n").alias("n"))
