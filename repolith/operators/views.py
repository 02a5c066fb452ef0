"""Tables behind the views: sunbursts, legends, logs, crowds, queues of work, locks, validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import inside, parent, ancestors

#: The work budget and what git work costs, in seconds.
BUDGET_S = 10.0
BLAME_FILE_S, EDIT_COMMIT_S = 0.034, 0.010


def sunburst(nodes: DataFrame) -> DataFrame:
    """``path, weight`` of every node, the root ``''`` included -> ``depth, start, end`` of its arc, as shares of a turn.

    Children share their parent's arc by weight, the largest first, then by path. Levels are joined from the
    root down, one join a level of the tree.
    """
    n = nodes.select("path", F.col("weight").cast("double").alias("weight")).withColumn("up", F.when(F.col("path") != "", parent(F.col("path"))))
    order = Window.partitionBy("up").orderBy(F.desc("weight"), "path")
    all_ = F.sum("weight").over(Window.partitionBy("up"))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = n.where("path <> ''").withColumn("a", F.when(all_ > 0, (upto - F.col("weight")) / all_).otherwise(0.0)).withColumn("b", F.when(all_ > 0, upto / all_).otherwise(0.0))
    depth = nodes.agg(F.max(F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))).first()[0] or 0
    level = nodes.where("path = ''").select("path", F.lit(0).alias("depth"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    out = level
    for d in range(1, depth + 1):
        above = level.select(F.col("path").alias("up"), F.col("start").alias("s"), (F.col("end") - F.col("start")).alias("span"))
        level = share.join(above, "up").select("path", F.lit(d).alias("depth"), (F.col("s") + F.col("a") * F.col("span")).alias("start"), (F.col("s") + F.col("b") * F.col("span")).alias("end"))
        out = out.unionByName(level)
    return out


def merge_slices(slices: DataFrame, floor: float) -> DataFrame:
    """``at, width, label`` in order -> runs of consecutive slices narrower than the floor as one.

    A merged run is called by its widest member if that is more than half of it, else "n others".
    """
    w = Window.orderBy("at")
    narrow = F.col("width") < floor
    s = slices.withColumn("narrow", narrow)
    starts = ~F.col("narrow") | ~F.coalesce(F.lag("narrow").over(w), F.lit(False))
    s = s.withColumn("run", F.sum(starts.cast("int")).over(w))
    g = s.groupBy("run").agg(F.min("at").alias("at"), F.sum("width").alias("width"), F.max_by("label", F.struct("width", -F.col("at"))).alias("widest"), F.max("width").alias("most"), F.count("*").alias("n"))
    label = F.when((F.col("n") == 1) | (F.col("most") * 2 > F.col("width")), F.col("widest")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" others")))
    return g.select("at", "width", label.alias("label"), "n")


def fold_rest(functions: DataFrame, density: float = 1.0) -> DataFrame:
    """Functions under total/(4000 * density^2) lines of their file as one crowd row a file: ``path, name, loc, members``."""
    total = functions.agg(F.sum("loc").alias("total"))
    # one number
    f = functions.crossJoin(F.broadcast(total))
    name = F.when(F.col("loc") < F.col("total") / F.lit(4000.0 * density**2), F.lit("rest")).otherwise(F.col("key"))
    return f.groupBy("path", name.alias("name")).agg(F.sum("loc").alias("loc"), F.count("*").alias("members"))


def log_page(commits: DataFrame, commit_files: DataFrame, scope: str, offset: int, count: int) -> DataFrame:
    """Commits that touch a path or anything under it, newest first, from ``offset`` on."""
    hit = commit_files.where(inside(F.col("path"), scope)).select("sha").distinct()
    return commits.join(hit, "sha", "left_semi").orderBy(F.desc("ts"), "seq").offset(offset).limit(count)


def hottest(nodes: DataFrame, n: int) -> DataFrame:
    """By temperature, then size."""
    return nodes.orderBy(F.desc_nulls_last("surprise"), F.desc("loc"), "key").limit(n)


def languages_of(files: DataFrame, scope: str = "") -> DataFrame:
    return files.where(inside(F.col("path"), scope) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("files"))


def by_need(blocked: Iterable[dict[str, str]]) -> dict[str, dict[str, list[str]]]:
    """Blocked rules grouped by what would open them: their ids and the different reasons."""
    out: dict[str, dict[str, list[str]]] = {}
    for b in blocked:
        group = out.setdefault(b["need"], {"rules": [], "why": []})
        group["rules"].append(b["rule"])
        if b["why"] not in group["why"]:
            group["why"].append(b["why"])
    return out


def first_mentions(listed: DataFrame) -> DataFrame:
    """``place, rule`` of a printed list -> where each rule comes first: there its background is told."""
    return listed.groupBy("rule").agg(F.min("place").alias("place"))


def keep_live(cache: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """Cache entries that are still of something."""
    return cache.join(live.select(key).distinct(), key, "left_semi")


def parse_once(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By content hash: different texts that the cache lacks, and (path, hash) of every file to join results back."""
    h = files.withColumn("hash", F.sha2("text", 256))
    return h.dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti"), h.select("path", "hash")


def resync(functions: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """One file parsed again: known functions get their new place and hash, those that are gone go, new ones wait for a scan."""
    keep = functions.where(F.col("path") != path)
    new = fresh.select("name", "ord", *[F.col(c).alias(f"new_{c}") for c in ("start_line", "loc", "body_hash")])
    same = functions.where(F.col("path") == path).join(new, ["name", "ord"])
    return keep.unionByName(same.select(*[F.col(f"new_{c}").alias(c) if c in ("start_line", "loc", "body_hash") else F.col(c) for c in functions.columns]))


def retest(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """What readers said of test code in place of conventions; a contract of the language stands. ``node, is_test, how``."""
    a = answers.select("node", F.col("is_test").alias("said"))
    n = nodes.join(a, "node", "left")
    told = (F.coalesce("how", F.lit("")) != "contract") & F.col("said").isNotNull()
    return n.select(*[c for c in nodes.columns if c not in ("is_test", "how")], F.when(told, F.col("said")).otherwise(F.col("is_test")).alias("is_test"), F.when(told, F.lit("reading")).otherwise(F.col("how")).alias("how"))


def invalid_reports(readings: DataFrame) -> DataFrame:
    """Readings that may not be stored: a trap without a note, a note that leaks tool syntax."""
    note = F.coalesce("note", F.lit(""))
    why = F.when(F.col("trap") & (F.trim(note) == ""), "trap without a note").when(note.rlike(r"</?(invoke|parameter|function_calls|tool_use)\b"), "tool syntax in the note")
    return readings.withColumn("why", why).where("why is not null")


def lens_locks(facts: DataFrame, lenses: dict[str, str]) -> dict[str, bool]:
    """Which lenses have anything to show: one pass over the fields behind them."""
    row = facts.agg(*[F.count(f).alias(name) for name, f in lenses.items()]).first()
    return {name: bool(row[name]) for name in lenses}


def estimate(files: int, commits: int, log_s: float) -> dict[str, float | bool]:
    """What a trace would cost, part by part, and whether it is within the budget of an unasked one."""
    blame, edits = files * BLAME_FILE_S, commits * EDIT_COMMIT_S
    total = log_s + blame + edits
    return {"log": log_s, "blame": blame, "edits": edits, "total": total, "affordable": total <= BUDGET_S}


def attach_unparsed(dirs: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Directories with how many files in them were not parsed."""
    return dirs.join(unparsed, "path", "left").withColumn("unparsed", F.coalesce("unparsed", F.lit(0)))


def author_category(rows: DataFrame, by: str) -> Column:
    """What a legend colours by: the language, the author of the newest line, or who has the most."""
    return {"lang": F.col("lang"), "newest": F.col("last_author"), "pile": F.col("main_author")}[by]


def in_scope(nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Nodes of which neither the path nor a directory above it is excluded; the root ``''`` excludes everything.

    Ancestors are exploded as paths alone and meet the excluded ones by key, so a hot directory is one row of the smaller side.
    """
    above = nodes.select("path").distinct().select("path", F.explode(ancestors(F.col("path"), itself=True)).alias("up"))
    out = above.join(excluded.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct()
    return nodes.join(out, "path", "left_anti")


def functions_of(functions: DataFrame, paths: DataFrame, columns: Iterable[str] = ()) -> DataFrame:
    """The functions in some files, with the named columns only (none: all)."""
    return functions.join(paths.select("path").distinct(), "path", "left_semi").select(*(list(columns) or functions.columns))


def replay_rollup(files: DataFrame) -> DataFrame:
    """``path, loc, funcs, commits`` of a replay's files -> the same of each directory above: sums, but of commits the greatest.

    A replay knows no set of commits of a directory, so the busiest file stands for it.
    """
    up = files.select(F.explode(ancestors(F.col("path"))).alias("dir"), "loc", "funcs", "commits")
    return up.groupBy(F.col("dir").alias("path")).agg(F.sum("loc").alias("loc"), F.sum("funcs").alias("funcs"), F.max("commits").alias("commits"))
