"""What a path was called before, and what lies between two commits.

A path *lives* from its arrival (added, copied, renamed to) to its retirement (deleted, renamed away). A rename links
two lives; a copy begins a new one and leaves its source alive. Chains of renames are followed by pointer doubling, so
a chain of n names takes about log2(n) joins.

Ancestry is asked of the commits' parent graph without walking it commit by commit: first parents form chains, a
commit's place on its chain is found by list ranking (pointer doubling again), and what a head reaches is a place on
each chain. Only the links between chains are walked, in as many rounds as a path changes chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, drop

#: Before all commits: paths that a stored state hands over live since then.
BEFORE = -1
SAME, GROWN, REWRITTEN = "same", "grown", "rewritten"


def events(changes: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """``path, idx, at, arrives, source``: what happens to each path; retirements of a commit (at 0) before its arrivals (1)."""
    none = F.lit(None).cast("string")
    gone = changes.where("op = 'delete'").select("path", "idx", F.lit(0).alias("at"), F.lit(False).alias("arrives"), none.alias("source"))
    left = changes.where("op = 'rename'").select(F.col("source").alias("path"), "idx", F.lit(0).alias("at"), F.lit(False).alias("arrives"), none.alias("source"))
    source = F.when(F.col("op") == "rename", F.col("source")).alias("source")
    come = changes.where("op <> 'delete'").select("path", "idx", F.lit(1).alias("at"), F.col("op").isin("rename", "copy").alias("arrives"), source)
    out = gone.unionByName(left).unionByName(come)
    if opening is None:
        return out
    return out.unionByName(opening.select("path", F.lit(BEFORE).cast(changes.schema["idx"].dataType).alias("idx"), F.lit(1).alias("at"), F.lit(True).alias("arrives"), none.alias("source")))


def lives(changes: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """``path, born, died, origin_path, origin_born, renames`` of every life of every path; ``died`` is null for living ones.

    ``changes``: idx, op (add, modify, delete, rename, copy), path, source (of renames and copies). ``opening`` is
    the living part of an earlier result, whose histories go on. A write to a path that does not live begins a life,
    whatever it is called; a rename onto a living path ends that life. The origin is the first life of a chain.
    """
    e = events(changes, opening)
    by = Window.partitionBy("path").orderBy("idx", "at")
    before = F.lag("at").over(by)
    starts = (F.col("at") == 1) & (before.isNull() | (before == 0) | F.col("arrives"))
    e = e.withColumn("starts", starts)
    e = e.withColumn("life", F.sum(F.col("starts").cast("long")).over(by)).where("life > 0")
    one = e.groupBy("path", "life").agg(F.min(F.when(F.col("starts"), F.col("idx"))).alias("born"), F.max(F.when(F.col("starts"), F.col("source"))).alias("source"), F.min(F.when(F.col("at") == 0, F.col("idx"))).alias("died"))
    # a life that another takes over ends with it
    after = F.lead("born").over(Window.partitionBy("path").orderBy("life"))
    one = cut(one.withColumn("died", F.coalesce("died", after)).drop("life"))
    # of a name that ended when this life began; if none did, the chain begins here
    came = one.where("source is not null").select("path", "born", "source")
    ended = one.select(F.col("path").alias("source"), F.col("died").alias("born"), F.col("born").alias("source_born"))
    linked = came.join(ended, ["source", "born"]).groupBy("path", "born").agg(F.max(F.struct("source_born", "source")).alias("from"))
    at = one.join(linked, ["path", "born"], "left").select(
        "path", "born", "died", F.coalesce("from.source", "path").alias("up"), F.coalesce("from.source_born", "born").alias("up_born"), F.col("from").isNotNull().cast("long").alias("renames")
    )
    at = cut(at)
    while True:
        above = at.select(F.col("path").alias("up"), F.col("born").alias("up_born"), F.col("up").alias("top"), F.col("up_born").alias("top_born"), F.col("renames").alias("more"))
        step = at.join(above, ["up", "up_born"], "left")
        # a first life stands for itself
        at, was = cut(step.select("path", "born", "died", F.coalesce("top", "up").alias("up"), F.coalesce("top_born", "up_born").alias("up_born"), (F.col("renames") + F.coalesce("more", F.lit(0))).alias("renames"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))), at
        drop(was)
        moved = at.where("moved").limit(1).count()
        at = at.drop("moved")
        if not moved:
            break
    found = at.select("path", "born", "died", F.col("up").alias("origin_path"), F.col("up_born").alias("origin_born"), "renames")
    if opening is None:
        return found
    # chains that begin in the stored state have its origins
    told = opening.select(F.col("path").alias("origin_path"), F.lit(BEFORE).cast("long").alias("origin_born"), F.col("origin_path").alias("o_path"), F.col("origin_born").alias("o_born"), F.col("renames").alias("o_renames"), F.col("born").alias("o_life"))
    both = found.join(told, (found.origin_path == told.origin_path) & (found.origin_born == told.origin_born), "left")
    return both.select(
        "path", F.when(found.born == BEFORE, F.col("o_life")).otherwise(found.born).alias("born"), "died",
        F.coalesce("o_path", found.origin_path).alias("origin_path"), F.coalesce("o_born", found.origin_born).alias("origin_born"), (found.renames + F.coalesce("o_renames", F.lit(0))).alias("renames"),
    )


def living(found: DataFrame) -> DataFrame:
    """The stored state: the lives that have not ended."""
    return found.where("died is null")


def with_origin(touches: DataFrame, found: DataFrame) -> DataFrame:
    """``path, idx, ...`` with the origin of the life that the path led then; null where it led none.

    An as-of join: both sides in the order of their path, the last life before each touch.
    """
    life = found.select("path", F.col("born").alias("idx"), F.lit(0).alias("late"), F.struct("origin_path", "origin_born", "died").alias("life"), F.lit(None).cast(touches.select(F.struct("*")).schema[0].dataType).alias("row"))
    rows = touches.select("path", "idx", F.lit(1).alias("late"), F.lit(None).cast(life.schema["life"].dataType).alias("life"), F.struct("*").alias("row"))
    by = Window.partitionBy("path").orderBy("idx", "late").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("life", ignorenulls=True).over(by)
    out = life.unionByName(rows).withColumn("life", last).where("row is not null")
    alive = F.col("life.died").isNull() | (F.col("row.idx") < F.col("life.died"))
    return out.select("row.*", F.when(alive, F.col("life.origin_path")).alias("origin_path"), F.when(alive, F.col("life.origin_born")).alias("origin_born"))


def history_of_living(touches: DataFrame, found: DataFrame) -> DataFrame:
    """``path, commits, first_idx, last_idx, renames`` of every living path, its earlier names included."""
    per = with_origin(touches, found).where("origin_path is not null").groupBy("origin_path", "origin_born").agg(F.countDistinct("idx").alias("commits"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return living(found).join(per, ["origin_path", "origin_born"]).select("path", "commits", "first_idx", "last_idx", "renames")


def chains(parents: DataFrame) -> DataFrame:
    """``sha, chain, place``: first-parent chains; the chain is named by its oldest commit, places count from there.

    ``parents``: sha, nth (0 for the first parent), parent (null for a root). Where several commits have one first
    parent the smallest goes on with its chain, and the others begin their own.
    """
    first = parents.where("nth = 0").select("sha", "parent")
    goes_on = first.where("parent is not null").groupBy("parent").agg(F.min("sha").alias("sha"))
    at = first.select("sha").join(goes_on.select("sha", F.col("parent").alias("up")), "sha", "left")
    at = cut(at.select("sha", F.coalesce("up", "sha").alias("up"), F.col("up").isNotNull().cast("long").alias("place")))
    while True:
        above = at.select(F.col("sha").alias("up"), F.col("up").alias("top"), F.col("place").alias("more"))
        step = at.join(above, "up", "left")
        at, was = cut(step.select("sha", F.coalesce("top", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))), at
        drop(was)
        moved = at.where("moved").limit(1).count()
        at = at.drop("moved")
        if not moved:
            return at.select("sha", F.col("up").alias("chain"), "place")


def reached(parents: DataFrame, placed: DataFrame, heads: DataFrame) -> DataFrame:
    """``head, chain, place``: how far up each chain a head (``head``: a commit) reaches; itself included."""
    here = placed.select("sha", "chain", "place")
    up = placed.select(F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    # links within a chain are what a place says
    links = cut(parents.where("parent is not null").join(here, "sha").join(up, "parent").where("chain <> to_chain or to_place >= place").select("chain", "place", "to_chain", "to_place"))
    known = cut(heads.join(placed, heads["head"] == placed["sha"]).select("head", "chain", "place"))
    news = known
    while not news.isEmpty():
        step = news.select("head", "chain", F.col("place").alias("upto")).join(links, "chain").where("place <= upto")
        step = step.groupBy("head", F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("place"))
        old = known.groupBy("head", "chain").agg(F.max("place").alias("had"))
        news = cut(step.join(old, ["head", "chain"], "left").where("had is null or place > had").select("head", "chain", "place"))
        known = cut(known.unionByName(news).groupBy("head", "chain").agg(F.max("place").alias("place")))
    return known


def carried(parents: DataFrame, banked: DataFrame, head: object) -> DataFrame:
    """``head, state, ahead`` for each banked head: whether its history can be carried on to ``head``, and by how many commits.

    ``same``: nothing to do; ``grown``: the banked head is an ancestor; ``rewritten``: it is not, or is no commit at all, so
    everything has to be walked again and ``ahead`` counts all that ``head`` reaches.
    """
    placed = cut(chains(parents))
    spark = parents.sparkSession
    now = spark.createDataFrame([(head,)], f"head {parents.schema['sha'].dataType.simpleString()}")
    of_head = reached(parents, placed, now).select("chain", F.col("place").alias("upto"))
    mine = placed.join(of_head, "chain").where("place <= upto").select("sha", "chain", "place")
    state = banked.join(mine.select(F.col("sha").alias("head")).withColumn("older", F.lit(True)), "head", "left")
    state = state.select("head", F.when(F.col("head") == F.lit(head), SAME).when(F.col("older"), GROWN).otherwise(REWRITTEN).alias("state"))
    sizes = mine.groupBy("chain").agg((F.max("place") + 1).alias("all"))
    grown = state.where(F.col("state") == GROWN).select("head")
    had = reached(parents, placed, grown).groupBy("head").agg(F.sum(F.col("place") + 1).alias("had"))
    total = sizes.agg(F.sum("all").alias("total"))
    out = state.join(had, "head", "left").crossJoin(F.broadcast(total))
    return out.select("head", "state", F.when(F.col("state") == SAME, 0).when(F.col("state") == GROWN, F.col("total") - F.col("had")).otherwise(F.col("total")).cast("long").alias("ahead"))


def ahead(parents: DataFrame, banked: object, head: object) -> DataFrame:
    """``sha`` of the commits that ``head`` reaches and ``banked`` does not: what an incremental walk has to read."""
    placed = cut(chains(parents))
    two = parents.sparkSession.createDataFrame([(banked,), (head,)], f"head {parents.schema['sha'].dataType.simpleString()}").distinct()
    both = reached(parents, placed, two)
    far = lambda h, name: both.where(F.col("head") == F.lit(h)).select("chain", F.col("place").alias(name))
    out = placed.join(far(head, "upto"), "chain").join(far(banked, "had"), "chain", "left")
    return out.where("place <= upto and (had is null or place > had)").select("sha")
