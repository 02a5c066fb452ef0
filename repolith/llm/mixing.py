"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A source whose target is at least its size gives whole copies of all
its documents; what is left of the target is a fixed-size sample of unequal probabilities: documents rank
by random odds divided by inclusion odds, and are taken in that order until the target is met.

The running sums that the ranking needs are histograms: per source, ranks fall into a fixed number of
bins, bins before the one in which the target is met are taken whole, and only that bin is sorted. So a
source with a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
SEED = "mix-1"
#: Parts that a group of equal rows is numbered in, where only some of them are taken.
PARTS = 64
WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources is broadcast up to this many rows (about 100 bytes each).
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size`` -> the same with ``target``.

    Sources by code point, null last, weigh as ``weights`` repeats. Together they get the sum of all sizes;
    no target exceeds ``most`` times its source's size. Sources that stop there are those with the smallest
    size for their weight, so one pass in that order finds where stopping ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the share per weight if this source and all after it did not stop; the first that holds is the level
    t = t.withColumn("level", F.col("left_words") / F.col("left_weight"))
    holds = F.col("level") * F.col("weight") <= F.col("most")
    t = t.withColumn("at", F.min(F.when(holds, F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("at") * F.col("weight"))).alias("target"))


def random_odds(id_col: Column, seed: str) -> Column:
    """Odds of a uniform number that depends on the identifier and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return u / (1.0 - u)


def mark_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``size, source_size, target, copies, taken``.

    A document's inclusion odds fall with the square root of its size, so that a sample of so many words
    holds more different documents. Each source closes its gap with the one document whose size fits best.
    Null texts and texts without words have size 0; whatever copies they get take no words. Different texts
    under one identifier (or none) share their odds and come in the order of a hash of the text. Rows that repeat
    identifier, source and text are one group; where the target falls within a group, as many of its rows are taken
    as fit. Reruns agree (on which rows, as far as they differ). A table without rows or without
    words takes nothing.
    """
    size = word_count(F.col(text_col))
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), tie.alias("tie"))
    # equal rows are counted, so they meet as one row a task
    base = base.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("n"))
    base = cut(base.withColumn("odds", random_odds(F.col("id"), seed)))
    # sqrt in thousandths adds up exactly in any order
    root = F.round(F.sqrt(F.greatest(F.col("size"), F.lit(1))) * 1000).cast("long")
    sums = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, root * F.col("n")).otherwise(0)).alias("roots"))
    sums = cut(sums)
    small = sums.count() <= BROADCAST_SOURCES
    sized = lambda df: F.broadcast(df) if small else df
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0).cast("long")
    plan = source_targets(sums.select("source", "source_size")).alias("t").join(sums.select(F.col("source").alias("s"), "roots"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = cut(plan.withColumn("scale", F.when(F.col("roots") > 0, F.col("rest") * 1000 / F.col("roots")).otherwise(0.0)).drop("roots"))

    def ranked(df: DataFrame, table: DataFrame) -> DataFrame:
        """rank: random odds over inclusion odds; bin: where it falls, both rise together."""
        out = df.join(sized(table.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        chance = F.least(F.greatest(F.col("scale") / F.sqrt(F.greatest(F.col("size"), F.lit(1))), F.lit(1e-12)), F.lit(1 - 1e-9))
        out = out.withColumn("rank", F.col("odds") / (chance / (1.0 - chance)))
        return out.withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * BINS).cast("int"))

    bins = ranked(base, plan).groupBy("source", "rest", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("words").over(up)).where(F.col("upto") > F.col("rest"))
    edge = bins.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = plan.alias("p").join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = cut(plan.select("source", "source_size", "target", "whole", "rest", "scale", F.col("edge.bin").alias("edge_bin"), F.coalesce("edge.before", F.lit(0)).alias("before")))

    key = F.struct("rank", "id", "tie")
    inner = Window.partitionBy("source").orderBy("rank", "id", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranked(base, plan).where(F.col("bin") == F.col("edge_bin")).withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(inner))
    inside = F.col("upto") <= F.col("rest")
    # the group that the target falls in, and how many of its rows fit
    fit_rows = F.floor((F.col("rest") - (F.col("upto") - F.col("size") * F.col("n"))) / F.greatest("size", F.lit(1))).cast("long")
    last = upto.groupBy("source").agg(
        F.max(F.when(inside, key)).alias("last"), F.max(F.when(inside, F.col("upto"))).alias("upto"),
        F.min(F.when(~inside, F.struct("rank", "id", "tie", fit_rows.alias("k"), "n", "size"))).alias("edge"),
    )
    plan = plan.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    part = F.coalesce(F.col("edge.k") * F.col("edge.size"), F.lit(0))
    plan = plan.withColumn("gap", F.col("rest") - F.coalesce("upto", "before") - part).drop("upto", "before")
    plan = cut(plan.withColumn("edge", F.struct(F.struct("edge.rank", "edge.id", "edge.tie").alias("key"), "edge.k", "edge.n")))

    in_sample = (F.col("rest") > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & F.coalesce(key <= F.col("last"), F.lit(False))))
    fits = ranked(base, plan).where((F.col("rest") > 0) & ~in_sample & (F.col("size") > 0))
    fits = fits.groupBy("source", "gap").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "id", "tie", "n")).alias("fit")).where(F.col("fit.off") < F.col("gap"))
    plan = plan.join(fits.select(F.col("source").alias("s"), F.struct(F.struct("fit.rank", "fit.id", "fit.tie").alias("key"), F.lit(1).cast("long").alias("k"), "fit.n").alias("fit")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = cut(plan.drop("gap"))

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), tie.alias("tie"))
    rows = ranked(rows.withColumn("odds", random_odds(F.col("id"), seed)), plan)
    # rows of a group that are taken once more though not all of it is
    of = lambda c: F.when(F.col(c).isNotNull() & F.col(f"{c}.k").isNotNull() & key.eqNullSafe(F.col(f"{c}.key")), F.col(f"{c}.k")).otherwise(0)
    whole_group = F.when(of("edge") > 0, F.col("edge.n")).when(of("fit") > 0, F.col("fit.n"))
    rows = rows.withColumn("sampled", in_sample.cast("long")).withColumn("some", F.when(F.col("sampled") == 0, of("edge") + of("fit")).otherwise(0)).withColumn("of", whole_group)
    told = lambda df, more: df.withColumn("copies", F.col("whole") + F.col("sampled") + more).select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    if not plan.where("(edge.k > 0 and edge.n > 1) or fit.n > 1").limit(1).count():
        return told(rows, F.col("some"))
    parted = (F.col("some") > 0) & (F.col("of") > F.col("some"))
    return told(rows.where(~parted), F.least("some", F.lit(1))).unionByName(told(first_of_groups(rows.where(parted)), F.col("once")))


def first_of_groups(rows: DataFrame) -> DataFrame:
    """``rows`` with ``once`` 1 for ``some`` rows of each group of equal ones, else 0; a large group is numbered in parts."""
    group = ["source", "rank", "id", "tie"]
    rows = cut(rows.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)))).withColumn("place", F.row_number().over(Window.partitionBy(*group, "dealt").orderBy("size")))
    before = F.sum("members").over(Window.partitionBy(*group).orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy(*group, "dealt").agg(F.count("*").alias("members")).withColumn("before", F.coalesce(before, F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in [*group, "dealt"]], "before")
    same = F.lit(True)
    for c in [*group, "dealt"]:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return rows.join(parts, same).withColumn("once", (F.col("before") + F.col("place") <= F.col("some")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, none for documents left out; columns as they came."""
    marked = mark_mix(docs, id_col, text_col, source_col, seed).where(F.col("copies") > 0)
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
