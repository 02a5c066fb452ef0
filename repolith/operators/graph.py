"""Call graphs: degrees, dependents, reachability from tests, locality, call resolution."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tasks import dealt


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``callers, calls, dependents`` of every node.

    Dependents are callers that are not known tests; null where it is not known whether the node is one.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("calls"))
    tests = nodes.select(F.col("node").alias("src"), F.coalesce("is_test", F.lit(False)).alias("src_test"))
    into = edges.join(tests, "src").groupBy("dst").agg(F.count("*").alias("callers"), F.sum(F.when(F.col("src_test"), 0).otherwise(1)).alias("dependents"))
    n = nodes.join(out, nodes.node == out.src, "left").join(into, nodes.node == into.dst, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.select("node", zero("callers").alias("callers"), zero("calls").alias("calls"), F.when(F.col("is_test").isNotNull(), zero("dependents")).alias("dependents"))


def locality(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``incident``: distinct neighbours either way; ``away``: those in another directory; ``gap``: their share.

    ``tasks``: how many the edges, twice as many as they come, are dealt to at each step.
    """
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = dealt(edges.select(F.inline(ways)), tasks, "dst").distinct()
    dirs = nodes.select("node", "dir")
    far = both.join(dirs.select(F.col("node").alias("dst"), F.col("dir").alias("other")), "dst").select("src", "other")
    seen = dealt(far, tasks, "src").join(dirs.select(F.col("node").alias("src"), F.col("dir").alias("own")), "src")
    counts = seen.groupBy("src").agg(F.count("*").alias("incident"), F.sum((F.col("own") != F.col("other")).cast("long")).alias("away"))
    n = nodes.join(counts, nodes.node == counts.src, "left")
    incident, away = F.coalesce("incident", F.lit(0)), F.coalesce("away", F.lit(0))
    return n.select("node", incident.alias("incident"), away.alias("away"), F.when(incident > 0, away / incident).alias("gap"))


def cut(df: DataFrame) -> DataFrame:
    """Materialises a round where the cluster can find it again: packed in the checkpoint folder if one is set, else in the cache.

    Like a checkpoint it ends the lineage and outlives executors, but it is stored by columns and packed.
    """
    shared = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    if shared.isDefined():
        folder = f"{shared.get().rstrip('/')}/round-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        # with the schema told, as an empty result may leave no file to read it from
        return df.sparkSession.read.schema(df.schema).parquet(folder)
    df = df.persist()
    df.count()
    return df


def stored(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver forgets the shuffles that led here: executors keep their files until it has."""
    df = cut(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def drop(df: DataFrame) -> None:
    """Gives back what ``cut`` stored, once nothing reads it any more."""
    session = df.sparkSession
    df.unpersist()
    if session.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def under_test(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, under_test``: reachable from a test through nodes that are not tests; null where unknown.

    A breadth-first search as joins: each round is one join of the frontier with the edges that lead to
    nodes not reached yet, and then drops the edges that it has followed, so cycles end, nothing is visited twice
    and the edges are read whole in the first round alone. Every round is materialised; the number of rounds is the
    graph's depth from its tests.
    """
    tests = nodes.where("is_test").select("node")
    walkable = nodes.where("is_test is null or not is_test").select("node")
    open_ = edges.join(walkable.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    frontier = cut(open_.join(tests.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
    reached = frontier
    before = None
    while not frontier.isEmpty():
        open_ = cut(open_.join(frontier.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        if before is not None:
            drop(before)
        before = open_
        frontier = cut(open_.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        reached = reached.unionByName(frontier)  # of parts that are all materialised
    hit = reached.withColumn("hit", F.lit(1))
    return nodes.join(hit, "node", "left").select("node", F.when(F.col("is_test").isNotNull(), F.coalesce("hit", F.lit(0))).alias("under_test"))


#: Languages that call each other.
FAMILIES = {"c": "c", "cpp": "c", "typescript": "ts", "tsx": "ts", "javascript": "ts"}


def family(lang: F.Column) -> F.Column:
    out = lang
    for k, v in FAMILIES.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def resolve_calls(calls: DataFrame, definitions: DataFrame, local_names: DataFrame | None = None) -> DataFrame:
    """``caller, call_id, callee`` for calls that resolve.

    ``calls``: caller, call_id, name, qualifier, path, dir, family, in_test; ``definitions``: key, name, owner,
    path, dir, family, exported, contract_test. Candidates share name and family. The nearest tier with
    candidates wins: owner named by the qualifier, same file, same directory, then anywhere; all candidates of
    a near tier are credited, anywhere only a single one. A name defined inside the caller resolves to
    nothing; a private function is seen in its own file alone; code that is no test does not call contract
    tests; nothing calls itself.
    """
    if local_names is not None:
        calls = calls.join(local_names.select("caller", "name").distinct(), ["caller", "name"], "left_anti")
    d = definitions.select("key", "name", "family", "owner", F.col("path").alias("d_path"), F.col("dir").alias("d_dir"), "exported", "contract_test")
    both = calls.join(d, ["name", "family"])
    both = both.where((F.coalesce("exported", F.lit(True)) | (F.col("path") == F.col("d_path"))) & (~F.coalesce("contract_test", F.lit(False)) | F.coalesce("in_test", F.lit(False))))
    tier = F.when(F.col("qualifier").isNotNull() & (F.col("owner") == F.col("qualifier")), 0).when(F.col("path") == F.col("d_path"), 1).when(F.col("dir") == F.col("d_dir"), 2).otherwise(3)
    both = both.withColumn("tier", tier)
    best = both.groupBy("caller", "call_id").agg(F.min(F.struct("tier")).alias("b"), F.count("*").alias("all"))
    chosen = both.join(best.select("caller", "call_id", F.col("b.tier").alias("tier"), "all"), ["caller", "call_id", "tier"])
    return chosen.where((F.col("tier") < 3) | (F.col("all") == 1)).where("caller <> key").select("caller", "call_id", F.col("key").alias("callee"))


def resolution_counts(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: calls resolved and unresolved."""
    hit = resolved.select("caller", "call_id").distinct().withColumn("hit", F.lit(1))
    both = calls.select("caller", "call_id").join(hit, ["caller", "call_id"], "left")
    return both.agg(F.count("hit").alias("resolved"), (F.count("*") - F.count("hit")).alias("unresolved"))


def callers_by_file(edges: DataFrame, nodes: DataFrame, key: object) -> DataFrame:
    """Who calls a node, grouped by file, those of its own file first: ``path, here, callers, names``."""
    own = nodes.where(F.col("node") == key).select(F.col("path").alias("own"))
    who = edges.where(F.col("dst") == key).join(nodes.select(F.col("node").alias("src"), "path", "name"), "src").crossJoin(F.broadcast(own.limit(1)))
    return who.groupBy("path").agg(F.max(F.col("path") == F.col("own")).alias("here"), F.count("*").alias("callers"), F.sort_array(F.collect_list("name")).alias("names"))


def clone_groups(functions: DataFrame) -> DataFrame:
    """``key, clone_group, clone_count`` for functions whose (family, shape) is shared; groups number from 1 by first site.

    ``functions``: key, family, shape (null where the body is too small).
    """
    f = functions.where("shape is not null")
    groups = f.groupBy("family", "shape").agg(F.count("*").alias("clone_count"), F.min("key").alias("first")).where("clone_count >= 2")
    groups = groups.withColumn("clone_group", F.row_number().over(Window.orderBy("first")))
    return f.join(groups, ["family", "shape"]).select("key", "clone_group", "clone_count")


def neighbours_by_file(edges: DataFrame, nodes: DataFrame, key: object) -> DataFrame:
    """Who a node calls, is called by and is a copy of, grouped by file: ``side, path, here, nodes, names``.

    ``nodes``: node, path, name, shape (null where a body has none). A node is no copy of itself.
    """
    own = nodes.where(F.col("node") == key).select(F.col("path").alias("own"), F.col("shape").alias("own_shape")).limit(1)
    callers = edges.where(F.col("dst") == key).select(F.col("src").alias("node"), F.lit("caller").alias("side"))
    callees = edges.where(F.col("src") == key).select(F.col("dst").alias("node"), F.lit("callee").alias("side"))
    # one row: the node that is asked of
    near = callers.unionByName(callees).join(nodes, "node").crossJoin(F.broadcast(own))
    copies = nodes.where(F.col("node") != key).join(F.broadcast(own), F.col("shape") == F.col("own_shape")).withColumn("side", F.lit("clone"))
    columns = ["side", "path", "own", "name"]
    found = near.select(columns).unionByName(copies.select(columns))
    return found.groupBy("side", "path").agg(F.max(F.col("path") == F.col("own")).alias("here"), F.count("*").alias("nodes"), F.sort_array(F.collect_list("name")).alias("names"))
