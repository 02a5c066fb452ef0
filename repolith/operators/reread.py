"""Readings applied to a tree that is rolled up already, and the summary of what has been read.

A roll-up's state holds sums, so a changed function changes them by a difference, along the folders above it and
nowhere else. An extreme is kept by comparison unless the function that held it has let go of it: only then, and only
for those folders, it is taken again from what lies below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from .rollup import HOT

SUMS = ("loc", "funcs", "w", "s", "d", "a", "h")
#: column of a function -> whether the greatest or the least of it stands for a folder
EXTREMES = {"age": "max", "touched": "min", "surprise": "max"}


def apply_readings(functions: DataFrame, readings: DataFrame) -> DataFrame:
    """``functions`` with ``surprise``, ``documented``, ``read`` and ``source`` of their readings (``key, surprise, documented, stale``).

    A stale reading and one without a grade leave the measured value; what is read says so. Readings of functions that
    are gone apply to nothing.
    """
    told = readings.where("not coalesce(stale, false)").select("key", F.struct("surprise", "documented").alias("told")).dropDuplicates(["key"])
    out = functions.drop("source").join(told, "key", "left")
    read = F.col("told").isNotNull()
    columns = {"surprise": F.coalesce("told.surprise", "surprise"), "documented": F.coalesce("told.documented", "documented"), "read": F.when(read, 1).otherwise(F.col("read").cast("int")), "source": F.when(read, "agent").otherwise("proxy")}
    return out.withColumns(columns).drop("told")


def parts(functions: DataFrame) -> DataFrame:
    """What a function adds to the sums of its folders, beside its extremes."""
    w = F.greatest("loc", F.lit(1)).cast("double")
    read = F.coalesce(F.col("read").cast("int"), F.lit(0)).cast("double")
    hot = F.when((read > 0) & (F.col("surprise") > HOT), w).otherwise(0.0)
    return functions.select("key", "path", "loc", F.lit(1).cast("long").alias("funcs"), w.alias("w"), (w * F.coalesce("surprise", F.lit(0.0))).alias("s"), (w * F.coalesce("documented", F.lit(0.0))).alias("d"), (w * read).alias("a"), hot.alias("h"), *EXTREMES)


def over_folders(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregated per file first, so that folders meet files and not functions."""
    return rows.select(F.explode(ancestors(F.col("path"), itself=True)).alias("path"), *[c for c in rows.columns if c != "path"]).groupBy("path").agg(*aggregates)


def extreme(name: str, of: str | None = None) -> Column:
    return (F.max if EXTREMES[name] == "max" else F.min)(of or name).alias(name)


def rollup_state(functions: DataFrame) -> DataFrame:
    """``path`` (every file and folder) with the sums and extremes of what lies below it."""
    by_file = parts(functions).groupBy("path").agg(*[F.sum(c).alias(c) for c in SUMS], *map(extreme, EXTREMES))
    return over_folders(by_file, *[F.sum(c).alias(c) for c in SUMS], *map(extreme, EXTREMES))


def rollup_delta(state: DataFrame, before: DataFrame, after: DataFrame, functions: DataFrame) -> DataFrame:
    """The state after some functions went from ``before`` to ``after`` (a key on one side only was added or removed).

    ``functions`` is the whole table as it is now; of it only files below folders that lost an extreme are read.
    Folders without functions go.
    """
    old, new = parts(before), parts(after)
    signed = old.select("path", *[(-F.col(c)).alias(c) for c in SUMS], *[F.col(c).alias(f"old_{c}") for c in EXTREMES], *[F.lit(None).cast("double").alias(f"new_{c}") for c in EXTREMES])
    signed = signed.unionByName(new.select("path", *SUMS, *[F.lit(None).cast("double").alias(f"old_{c}") for c in EXTREMES], *[F.col(c).alias(f"new_{c}") for c in EXTREMES]))
    changes = [*(F.sum(c).alias(c) for c in SUMS), *((F.max if how == "max" else F.min)(f"{side}_{c}").alias(f"{side}_{c}") for c, how in EXTREMES.items() for side in ("old", "new"))]
    moved = over_folders(signed.groupBy("path").agg(*changes), *changes).select("path", *[F.col(c).alias(f"by_{c}") for c in SUMS], *[f"{side}_{c}" for c in EXTREMES for side in ("old", "new")])
    both = state.join(moved, "path", "full")
    out = both.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"by_{c}", F.lit(0)) for c in SUMS})
    # a folder has lost its extreme if one that had it changed to something lesser
    better = {c: F.greatest if how == "max" else F.least for c, how in EXTREMES.items()}
    lost = {c: F.coalesce((F.col(f"old_{c}") == F.col(c)) & ((F.col(f"new_{c}") < F.col(c)) if how == "max" else (F.col(f"new_{c}") > F.col(c))) | (F.col(f"old_{c}") == F.col(c)) & F.col(f"new_{c}").isNull(), F.lit(False)) for c, how in EXTREMES.items()}
    any_lost = F.lit(False)
    for x in lost.values():
        any_lost = any_lost | x
    out = out.withColumn("lost", any_lost).withColumns({c: better[c](c, f"new_{c}") for c in EXTREMES}).select("path", *SUMS, *EXTREMES, "lost").where("funcs > 0")
    wanted = out.where("lost").select("path")
    below = functions.select("path", *EXTREMES).groupBy("path").agg(*map(extreme, EXTREMES))
    again = below.select(F.explode(ancestors(F.col("path"), itself=True)).alias("path"), *EXTREMES).join(wanted, "path", "left_semi").groupBy("path").agg(*map(extreme, EXTREMES))
    again = again.select("path", *[F.col(c).alias(f"again_{c}") for c in EXTREMES])
    return out.join(again, "path", "left").select("path", *SUMS, *[F.when(F.col("lost"), F.col(f"again_{c}")).otherwise(F.col(c)).alias(c) for c in EXTREMES])


def figures(state: DataFrame) -> DataFrame:
    """Means by lines and shares of a state."""
    mean = lambda c: F.col(c) / F.col("w")
    return state.select("path", "loc", "funcs", mean("s").alias("surprise"), mean("d").alias("documented"), mean("a").alias("analysed_share"), F.when(F.col("a") > 0, F.col("h") / F.col("a")).alias("hot_share"), "age", "touched", F.col("surprise").alias("top_surprise"))


GRADES = ("full", "most", "some", "none")


def summary(functions: DataFrame) -> DataFrame:
    """One row: functions in scope, excluded, read, stale, unread, traps, and how many have each grade.

    ``functions``: excluded, predicted (a grade or null), surprised, legible, trap, stale, has_reading. A reading without
    a grade is ``none`` where it surprised and ``full`` where not. Unread is what is neither read nor stale.
    """
    own = ~F.coalesce("excluded", F.lit(False))
    stale = own & F.col("has_reading") & F.coalesce("stale", F.lit(False))
    read = own & F.col("has_reading") & ~F.coalesce("stale", F.lit(False))
    grade = F.coalesce("predicted", F.when(F.coalesce("surprised", F.lit(False)), "none").otherwise("full"))
    n = lambda x: F.coalesce(F.count_if(x), F.lit(0)).cast("long")
    return functions.agg(
        n(own).alias("functions"), n(~own).alias("excluded"), n(read).alias("read"), n(stale).alias("stale"), (n(own) - n(read) - n(stale)).alias("unread"), n(read & F.coalesce("trap", F.lit(False))).alias("traps"),
        *[n(read & (grade == g)).alias(f"predicted_{g}") for g in GRADES], *[n(read & (F.col("legible") == g)).alias(f"legible_{g}") for g in GRADES],
    )


def hottest(functions: DataFrame, most: int = 8) -> DataFrame:
    """The read functions in scope above the hot line, most surprising first, then longest: ``place, key, surprise, loc``."""
    hot = functions.where((F.col("surprise") > HOT) & (F.col("read").cast("int") > 0) & ~F.coalesce("excluded", F.lit(False)))
    top = hot.orderBy(F.desc("surprise"), F.desc("loc"), "key").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("surprise"), F.desc("loc"), "key")).alias("place"), "key", "surprise", "loc")


def frame_tree(deltas: DataFrame, idx: int, since: int) -> DataFrame:
    """``path, kind, functions, lines, appeared, edited`` of the tree as of an index, with what happened after ``since``.

    Both frames come of one pass over the changes: each function's last change up to either index. A function appeared
    if it lives now and did not then, and was edited if it lived then and changed; a file or folder appeared if nothing
    below it lived then, and was edited if anything below appeared, changed or went. Only what lives now is told.
    """
    columns = ("op", "path", "loc", "idx")
    upto = F.col("idx") <= since
    now, then = F.max_by(F.struct(*columns), "idx"), F.max_by(F.when(upto, F.struct(*columns)), F.when(upto, F.col("idx")))
    f = deltas.where(F.col("idx") <= idx).groupBy("func_id").agg(now.alias("now"), then.alias("then"))
    lives, lived = F.col("now.op") == "set", F.coalesce(F.col("then.op") == "set", F.lit(False))
    here = f.where(lives).select(F.col("now.path").alias("path"), F.lit(1).cast("long").alias("functions"), F.col("now.loc").alias("lines"), (lived & (F.col("then.path") == F.col("now.path"))).cast("long").alias("before"), (~lived | (F.col("now.idx") > since)).cast("long").alias("news"))
    # what was there and is gone, or moved away, is news of where it was
    gone = f.where(lived & (~lives | (F.col("now.path") != F.col("then.path")))).select(F.col("then.path").alias("path"), F.lit(0).cast("long").alias("functions"), F.lit(0).cast("long").alias("lines"), F.lit(1).cast("long").alias("before"), F.lit(1).cast("long").alias("news"))
    sums = [F.sum(c).alias(c) for c in ("functions", "lines", "before", "news")]
    files = here.unionByName(gone).groupBy("path").agg(*sums).withColumn("file", F.lit(1))
    tree = over_folders(files.withColumn("leaf", F.col("path")), *sums, F.max(F.when(F.col("path") == F.col("leaf"), 1).otherwise(0)).alias("file"))
    return tree.where("functions > 0").select("path", F.when(F.col("file") == 1, "file").otherwise("dir").alias("kind"), "functions", "lines", (F.col("before") == 0).alias("appeared"), ((F.col("before") > 0) & (F.col("news") > 0)).alias("edited"))
