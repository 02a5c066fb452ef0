"""Roll-ups along the path hierarchy, size bands, histograms by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import BAND_ENDS, LEAST_MEMBERS, band
from ..functions.paths import ancestors, parent
from .graph import cut

HOT = 0.5


def tree_rollup(functions: DataFrame) -> DataFrame:
    """Every file and directory with the sums, means and extremes of what lies below it.

    ``functions``: path (its file), loc, ncloc, cognitive, surprise, documented, churn, age, touched, read, tangle,
    callers, calls. Means weigh by lines, a line at least; tangle's over children that have one, each weighed
    by its whole lines at every level; age is the oldest, touched the latest. Wiring is null where no function
    has any. hot and analysed shares are of lines, over read functions.

    Levels are taken from the deepest up, since the mean of means at a level weighs a child by all its lines.
    """
    w = F.greatest("loc", F.lit(1)).cast("double")
    read, hot = F.col("read").cast("double"), (F.col("surprise") > HOT).cast("double")
    nodes = functions.select(
        F.col("path").alias("up"), "loc", "ncloc", F.lit(1).cast("long").alias("funcs"), "cognitive", w.alias("w"), (w * F.col("surprise")).alias("s"),
        (w * F.col("documented")).alias("d"), (w * F.col("churn")).alias("c"), F.col("age"), F.col("touched"), "tangle",
        F.when(F.col("tangle").isNotNull(), w).alias("tw"), (w * read).alias("a"), F.when(read > 0, w * hot).otherwise(0.0).alias("h"), "callers", "calls",
    )

    def level(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("up").alias("path")).agg(
            *[F.sum(c).alias(c) for c in ("loc", "ncloc", "funcs", "cognitive", "w", "s", "d", "c", "a", "h", "callers", "calls")],
            F.max("age").alias("age"), F.min("touched").alias("touched"),
            (F.sum(F.col("tangle") * F.col("tw")) / F.sum("tw")).alias("tangle"),
        )

    def up(df: DataFrame) -> DataFrame:
        return df.select(parent(F.col("path")).alias("up"), "loc", "ncloc", "funcs", "cognitive", "w", "s", "d", "c", "age", "touched", "tangle", F.when(F.col("tangle").isNotNull(), F.greatest("loc", F.lit(1)).cast("double")).alias("tw"), "a", "h", "callers", "calls")

    # each level is computed once, whatever stands on it
    files = cut(level(nodes))
    depth = files.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    steps = F.size(F.split("path", "/"))
    out, below = [files.withColumn("kind", F.lit("file"))], files
    for d in range(depth, 0, -1):
        # nodes at this depth whose parents are one up; shallower files wait their turn
        here = below.where((steps == d) & (F.col("path") != ""))
        waiting = below.where((steps < d) & (F.col("path") != ""))
        dirs = cut(level(up(here)))
        out.append(dirs.withColumn("kind", F.lit("dir")))
        below = waiting.unionByName(dirs)
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    # a directory that holds both files and directories was summed in parts
    merged = every.groupBy("path").agg(
        F.max("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("loc", "ncloc", "funcs", "cognitive", "w", "s", "d", "c", "a", "h", "callers", "calls")],
        F.max("age").alias("age"), F.min("touched").alias("touched"),
        (F.sum(F.col("tangle") * F.greatest("loc", F.lit(1))) / F.sum(F.when(F.col("tangle").isNotNull(), F.greatest("loc", F.lit(1))))).alias("tangle"),
    )
    return merged.select(
        "path", "kind", "loc", "ncloc", "funcs", "cognitive", (F.col("s") / F.col("w")).alias("surprise"), (F.col("d") / F.col("w")).alias("documented"),
        (F.col("c") / F.col("w")).alias("churn"), "age", "touched", "tangle", "callers", "calls",
        (F.col("a") / F.col("w")).alias("analysed_share"), F.when(F.col("a") > 0, F.col("h") / F.col("a")).alias("hot_share"),
    )


def shares(functions: DataFrame) -> DataFrame:
    """Per directory: share of functions called, reaching out and undocumented, and of lines that are opaque."""
    f = functions.select(F.explode(ancestors(F.col("path"), itself=True)).alias("dir"), "callers", "calls", "has_doc", "loc", "surprise")
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom)
    n = F.count("*")
    return f.groupBy("dir").agg(
        ratio(F.sum((F.col("callers") > 0).cast("long")), F.count("callers")).alias("called"),
        ratio(F.sum((F.col("calls") > 0).cast("long")), F.count("calls")).alias("reaching"),
        ratio(F.sum((~F.col("has_doc")).cast("long")), n).alias("undocumented"),
        ratio(F.sum(F.when(F.col("surprise") > HOT, F.col("loc"))), F.sum(F.when(F.col("surprise").isNotNull(), F.col("loc")))).alias("opaque"),
    )


def histogram(rows: DataFrame, bucket: Column, ramp: Column, by_dir: bool = False) -> DataFrame:
    """Per bucket: functions, lines and mean ramp; by directory, each sees all below it.

    With a boolean column ``whole``, directories with a descendant that is not whole are left out.
    """
    rows = rows.withColumn("bucket", bucket).withColumn("ramp", ramp)
    keys = ["bucket"]
    if by_dir:
        # sums per file first: the explosion over ancestors then works on buckets instead of functions
        whole = F.min("whole") if "whole" in rows.columns else F.lit(True)
        files = rows.groupBy("path", "bucket").agg(F.count("*").alias("n"), F.sum("loc").alias("l"), F.sum("ramp").alias("r"), F.count("ramp").alias("k"), whole.alias("whole"))
        rows = files.withColumn("dir", F.explode(ancestors(F.col("path"))))
        partial = rows.groupBy("dir", "bucket").agg(F.sum("n").alias("functions"), F.sum("l").alias("lines"), (F.sum("r") / F.sum("k")).alias("mean_ramp"), F.min("whole").alias("whole"))
        whole_dir = F.min("whole").over(Window.partitionBy("dir"))
        return partial.withColumn("whole", whole_dir).where("whole").drop("whole")
    return rows.groupBy(*keys).agg(F.count("*").alias("functions"), F.sum("loc").alias("lines"), F.avg("ramp").alias("mean_ramp"))


def band_medians(functions: DataFrame, least: int = LEAST_MEMBERS) -> DataFrame:
    """``band, size_from, size_to, members, median``: the upper median of cognitive for each size band.

    A band with fewer than ``least`` members joins the next lower band that has any, from the top down; one
    that is lowest of all stands as it is. The merge map has nine rows and is made on the driver.
    """
    f = functions.where("cognitive is not null and ncloc is not null").select(band(F.col("ncloc")).alias("band"), "cognitive")
    # counts of values, not rows, are what is merged and sorted: few even where a band holds most functions; functions are read once
    values = cut(f.groupBy("band", "cognitive").agg(F.count("*").alias("n")))
    counts = {r["band"]: r["n"] for r in values.groupBy("band").agg(F.sum("n").alias("n")).collect()}
    into = merge_bands(counts, least)
    target = F.lit(None).cast("int")
    for k, v in into.items():
        target = F.when(F.col("band") == k, v).otherwise(target)
    values = values.withColumn("band", target).groupBy("band", "cognitive").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("band").orderBy("cognitive")
    values = values.withColumn("upto", F.sum("n").over(w)).withColumn("members", F.sum("n").over(Window.partitionBy("band")))
    middle = F.floor(F.col("members") / 2)
    medians = values.where((F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)).select("band", "members", F.col("cognitive").alias("median"))
    spans = sorted({v: (min(k for k, x in into.items() if x == v), max(k for k, x in into.items() if x == v)) for v in into.values()}.items())
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for v, (a, b) in spans:
        low = F.when(F.col("band") == v, 0 if a == 0 else BAND_ENDS[a - 1] + 1).otherwise(low)
        high = F.when(F.col("band") == v, BAND_ENDS[b] if b < len(BAND_ENDS) else None).otherwise(high)
    return medians.select("band", low.alias("size_from"), high.alias("size_to"), "members", "median")


def merge_bands(counts: dict[int, int], least: int = LEAST_MEMBERS) -> dict[int, int]:
    """Which band each band counts with."""
    filled = sorted(b for b, n in counts.items() if n)
    size, into = dict(counts), {b: b for b in filled}
    for k in range(len(filled) - 1, 0, -1):
        b, lower = filled[k], filled[k - 1]
        if size[b] < least:
            size[lower] += size[b]
            for x in into:
                if into[x] == b:
                    into[x] = lower
    return into


def with_medians(functions: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds ``median`` of each function's band, by the range of sizes that a merged band covers (nine rows at most)."""
    m = F.broadcast(medians.select("size_from", "size_to", "median"))
    on = (F.col("ncloc") >= F.col("size_from")) & (F.col("size_to").isNull() | (F.col("ncloc") <= F.col("size_to")))
    return functions.join(m, on, "left").drop("size_from", "size_to")


def collapse_chains(dirs: DataFrame, most: int = 64) -> DataFrame:
    """``path, parent, children, dir_children`` of directories -> ``path, name``: chains of single directories as one name.

    A directory that holds nothing but one directory joins it. Names are found by walking each path's own
    ancestors, so no rounds are needed.
    """
    single = dirs.where("children = 1 and dir_children = 1").select(F.col("path").alias("up"), F.lit(True).alias("joins"))
    chain = dirs.where("not (children = 1 and dir_children = 1)").select("path", F.posexplode(ancestors(F.col("path"), itself=True)).alias("depth", "up"))
    chain = chain.join(single, "up", "left")
    kept = chain.where((F.col("up") != F.col("path")) & F.col("joins").isNull()).groupBy("path").agg(F.max("depth").alias("base"))
    named = dirs.where("not (children = 1 and dir_children = 1)").select("path").join(kept, "path", "left")
    parts = F.split("path", "/")
    from_ = F.coalesce("base", F.lit(0)) + 1
    return named.select("path", F.array_join(F.slice(parts, from_, F.greatest(F.size(parts) - from_ + 1, F.lit(0))), "/").alias("name"))
