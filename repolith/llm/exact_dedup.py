"""Exact de-duplication by sorting contents.

Texts are normalised by lower-casing A-Z. Sampled splitters range-partition the rows by the head of the
normalised text, an external sort inside each head places equal texts next to each other, and each row is
compared in full with its neighbour; one row of every run stays. All of it is DataFrame code.

Heads and texts that a sample finds often would fill a partition. The rows of a frequent head are dealt by a
hash of the whole text, so equal texts stay together; the rows of a frequent text are dealt by identifier over
salts. Such texts are settled first: the salts' rows are sorted and compared, then one row of each salt's run
with those of the others, in full again. The sample decides how rows are dealt and nothing else: a frequent
text that it misses is only a larger group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, shuffle_partitions

HEAD_CHARS = 24
#: Rows are called frequent above a quarter of an even partition; of those just there the sample sees so many.
SEEN = 64


def runs(rows: DataFrame, cell: list[str], in_order: Column) -> DataFrame:
    """``rows`` with ``run``: equal neighbours by ``norm`` have one number inside each cell."""
    place = Window.partitionBy(*cell).orderBy("norm", in_order)
    before = F.lag("norm").over(place)
    starts = rows.withColumn("starts", (before.isNull() | (before != F.col("norm"))).cast("int"))
    return starts.withColumn("run", F.sum("starts").over(place.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``keep_id, group_size, kept, text_sha256``.

    Null texts count as empty and equal each other. ``keep`` names the identifier that stays in a group,
    ``largest`` or ``smallest``; a null identifier stays only where the group has no other. Of rows that
    repeat both identifier and text exactly one is kept. An empty table gives an empty result. The input's
    columns travel inside ``row``, so their names cannot clash with the result's.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    head, whole = F.substring("norm", 1, HEAD_CHARS), F.xxhash64("norm")
    in_order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    best = F.max if keep == "largest" else F.min

    # what is frequent: at most 8 x the shuffle partitions heads and as many texts, of fixed width
    parts, total = shuffle_partitions(spark), docs.count()
    cell = max(1, -(-total // (4 * parts)))
    share = min(1.0, SEEN / cell)
    sample = docs if share == 1 else docs.sample(share, 7)
    seen = cut(sample.select(norm.alias("norm")).select(head.alias("head"), whole.alias("whole")).groupBy("head", "whole").agg(F.count("*").alias("n")))
    least = F.col("n") > share * cell / (1 if share == 1 else 2)
    dealt_in = lambda n: F.ceil(n / F.lit(share * cell)).cast("int")
    heads = F.broadcast(seen.groupBy("head").agg(F.sum("n").alias("n")).where(least).select("head", dealt_in(F.col("n")).alias("slices")))
    texts = cut(seen.where(least).select("head", "whole", dealt_in(F.col("n")).alias("salts")))

    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), norm.alias("norm"))
    rows = rows.select("row", "id", head.alias("head"), whole.alias("whole"))
    again = ascii_lower(F.coalesce(F.col("row")[text_col], F.lit("")))
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")

    settled = None
    if not texts.isEmpty():
        hot = rows.join(F.broadcast(texts), ["head", "whole"]).select("id", "head", "whole", salt.alias("salt"), again.alias("norm"))
        in_salts = ["head", "whole", "salt"]
        found = runs(hot, in_salts, in_order).groupBy(*in_salts, "run").agg(F.first("norm").alias("norm"), best("id").alias("id"), F.count("*").alias("size")).drop("run")
        found = runs(found, ["head", "whole"], in_order).groupBy("head", "whole", "run").agg(F.first("norm").alias("norm"), best("id").alias("hot_keep"), F.sum("size").alias("hot_size"))
        settled = F.broadcast(cut(found.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "hot_keep", "hot_size")))

    rows = rows.join(heads, "head", "left").join(F.broadcast(texts), ["head", "whole"], "left")
    rows = rows.select("row", "id", "head", F.coalesce(F.pmod("whole", "slices"), F.lit(0)).cast("int").alias("slice"), F.coalesce(salt, F.lit(0)).alias("salt"))
    place = ["head", "slice", "salt"]
    sorted_rows = runs(rows.repartitionByRange(*place).withColumn("norm", again), place, in_order)
    run = Window.partitionBy(*place, "run")
    marked = sorted_rows.select(
        "row", "id", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.row_number().over(run.orderBy(in_order)).alias("place"),
        F.first("id").over(run.orderBy(in_order)).alias("run_keep"),
        F.count("*").over(run).alias("run_size"),
    )
    keep_id, size = F.col("run_keep"), F.col("run_size")
    if settled is not None:
        marked = marked.join(settled, "sha", "left")
        is_hot = F.col("hot_size").isNotNull()
        keep_id, size = F.when(is_hot, F.col("hot_keep")).otherwise(keep_id), F.coalesce("hot_size", size)
    kept = (F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)
    return marked.select("row", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as they came."""
    return mark_duplicates(docs, id_col, text_col, keep).where("kept").select("row.*")
