"""Sharding along a Hilbert curve.

Metadata dimensions are quantised into ``2**bits`` levels each, the rows are put in the order of their
cell's place on the Hilbert curve through that grid, and the order is cut into runs of equal length. A
shard then covers a compact region in every dimension at once, so readers that filter on any of them
skip most files. All of it is DataFrame code.

The global place of a row is the sum of three numbers: rows in earlier cells, rows of its cell in earlier
slices of the identifier, and its place in its own slice. The first two come from a table of counts with
at most ``2**(bits*dimensions) * SLICES`` rows; only the third needs a sort, of at most about
``rows/SLICES`` rows even where one cell holds most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 4
SLICES = 64
ACCURACY = 2000
#: Characters by which texts are dealt when they are put in order, and the most cells that are counted.
HEAD = 4
MOST_CELLS = 1 << 20


def order_number(column: Column, kind: T.DataType) -> Column:
    """What orders like the column: a number, or the whole text itself."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return column.cast("string")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_timestamp(column).cast("double")
    return column.cast("double")


def level(number: Column, splitters: list) -> Column:
    """How many of the splitters are not above the number; null counts as lowest."""
    parts = [F.when(number >= F.lit(s), 1).otherwise(0) for s in splitters]
    total = F.lit(0)
    for p in parts:
        total = total + p
    return F.when(number.isNull(), 0).otherwise(total).cast("int")


def text_splitters(rows: DataFrame, name: str, parts: int, total: int) -> list[str]:
    """Texts that cut those of a column into even parts: the first of each part but one, counted over all rows.

    Different texts are counted first. The places of a text are those of all texts with lesser heads and of lesser
    texts with its head, so the texts are sorted by head, and one task sees heads alone.
    """
    values = rows.select(F.col(name).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    values = values.withColumn("head", F.substring("v", 1, HEAD))
    heads = values.groupBy("head").agg(F.sum("n").alias("k"))
    known = heads.agg(F.sum("k")).first()[0] or 0
    # as ntile deals rows: the first parts have one more where they do not come out even
    size, more = divmod(known, parts)
    starts = sorted({k * size + min(k, more) for k in range(1, parts)} - {known})
    if not starts:
        return []
    before = heads.select("head", (F.sum("k").over(Window.orderBy("head")) - F.col("k")).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("head").orderBy("v"))
    placed = values.join(before, "head").withColumn("upto", upto)
    first = F.exists(F.array(*[F.lit(s) for s in starts]), lambda s: (s >= F.col("upto") - F.col("n")) & (s < F.col("upto")))
    return sorted(r["v"] for r in placed.where(first).select("v").collect())


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a grid point with ``bits`` bits on each axis, as a long.

    The axes are turned into the curve's transposed form by undoing its rotations bit by bit from the top,
    then Gray-coded and interleaved. The steps run as folds over an array, so the expression stays small.
    """
    n = len(axes)
    point = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = (q - 1).cast("long")
        head, own = F.element_at(x, 1), F.element_at(x, i + 1)
        flip = own.bitwiseAND(q.cast("long")) != 0
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        new_head = F.when(flip, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(swap))
        new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, new_head).when(j == i, new_own).otherwise(v))

    x = F.aggregate(steps, point, turn) if bits > 1 else point
    running = F.aggregate(x, F.array().cast("array<long>"), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("long"))))))
    state = F.struct(running.alias("x"))

    def finish(s: Column) -> Column:
        x = s["x"]
        last = F.element_at(x, -1)
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
        turn_by = F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        gray = F.transform(x, lambda v: v.bitwiseXOR(turn_by))
        planes = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
        return F.aggregate(planes, F.lit(0).cast("long"), lambda acc, b: F.aggregate(gray, acc, lambda a, v: a * 2 + F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long"))))

    return F.element_at(F.transform(F.array(state), finish), 1)


def assign_shards(docs: DataFrame, dims: list[Column], shards: int, id_col: Column, tie: Column, bits: int = BITS, slices: int = SLICES) -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``curve, shard, slot``.

    ``dims`` are columns of ``docs`` (numbers, times or texts). Shard sizes in rows differ by at most one;
    slots count from 0 without gaps in each shard and follow the curve, then the identifier, then ``tie``.
    Nulls in a dimension or the identifier sort lowest. Rows equal in all of these are interchangeable.
    With fewer rows than shards the surplus shards stay empty.
    """
    if (slices << (bits * len(dims))) > MOST_CELLS:
        raise ValueError("too many cells to count and broadcast: take fewer bits, dimensions or slices")
    kinds = docs.select(*[d.alias(f"n{i}") for i, d in enumerate(dims)], id_col.alias("nid")).schema
    names = [*(f"n{i}" for i in range(len(dims))), "nid"]
    rows = docs.select(F.struct("*").alias("row"), id_col.alias("id"), tie.alias("tie"), *[order_number(c, kinds[n].dataType).alias(n) for n, c in zip(names, [*dims, id_col], strict=True)])
    parts = {n: slices if n == "nid" else 1 << bits for n in names}
    texts = [n for n in names if isinstance(kinds[n].dataType, (T.StringType, T.BinaryType))]
    numbers = [F.percentile_approx(n, [k / parts[n] for k in range(1, parts[n])], ACCURACY).alias(n) for n in names if n not in texts and parts[n] > 1]
    found = rows.agg(F.count("*").alias("total"), *numbers).first().asDict()
    found |= {n: text_splitters(rows, n, parts[n], found["total"]) for n in texts}
    # repeated splitters would leave levels empty
    splitters = lambda name: sorted(set(found.get(name) or []))
    axes = [level(F.col(f"n{i}"), splitters(f"n{i}")) for i in range(len(dims))]
    rows = rows.select("row", "id", "tie", *[a.alias(f"a{i}") for i, a in enumerate(axes)], level(F.col("nid"), splitters("nid")).alias("slice"))
    names = [f"a{i}" for i in range(len(dims))]

    counts = rows.groupBy(*names, "slice").agg(F.count("*").alias("n"))
    cells = counts.groupBy(*names).agg(F.sum("n").alias("cell_n"))
    cells = cells.withColumn("curve", hilbert_index([F.col(a) for a in names], bits))
    upto = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_n").over(upto), F.lit(0))).withColumn("total", F.sum("cell_n").over(Window.partitionBy()))
    in_cell = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("slice_before", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).join(cells, names).select(*names, "slice", "curve", "total", (F.col("cell_before") + F.col("slice_before")).alias("before"))

    place = F.row_number().over(Window.partitionBy(*names, "slice").orderBy(F.col("id").asc_nulls_first(), F.col("tie").asc_nulls_first()))
    # at most 2**(bits*dims)*slices rows of about 40 bytes, whatever the input
    placed = rows.withColumn("place", place).join(F.broadcast(offsets), [*names, "slice"])
    rank = F.col("before") + F.col("place") - 1
    # integer arithmetic on longs: rank * shards stays exact up to 2**63
    placed = placed.withColumn("rank", rank).withColumn("shard", F.expr(f"rank * {int(shards)} div total").cast("int"))
    first = F.expr(f"(shard * total + {int(shards) - 1}) div {int(shards)}")
    return placed.withColumn("slot", F.col("rank") - first).select("row", "curve", "shard", "slot")
