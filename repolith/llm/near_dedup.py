"""SimHash near duplicates confirmed by the Jaccard similarity of word shingles, without loss.

Two texts are near if their sets of five-word shingles have a Jaccard similarity of at least 0.8. Such pairs
differ in about ten of 64 fingerprint bits, and no dealing by blocks is both selective and complete at that
distance. So texts meet under shared shingles instead, by a prefix filter, which misses none: under any common
order of shingles two near sets share one of the first ``n - ceil(0.8 n) + 1`` of each. The order puts shingles
that a sample of documents repeats last, so prefixes are made of rare ones; the sample decides how many
candidates there are, never which pairs are found.

Under each shingle the SimHash fingerprints, rotated by the shingle's own amount, are sorted by Gray rank, and
neighbours within a few bits are confirmed on the sets themselves, made again from the texts. That joins a large
group of near copies to one component without comparing it pair by pair. Only shingles under which several
components are left are searched for more: sizes, places in the prefix and a bitmap of the set bound what a pair
can have in common, and what passes is confirmed too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, cut, release_shuffles, released
from .simhash import SEED, components, gray_rank, keep_first, key_of, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Documents that the order of shingles is made from, and how often one is repeated there to come late.
SAMPLE = 20_000
REPEATED = 4
MOST_REPEATED = 1 << 16
#: Longs of the bitmaps that are compared first. A set's own bitmap has about a bit a shingle and folds to them.
WORDS = 8
PAIR_BLOCK = 256
#: Candidates that a task holds before it passes on the different ones.
HELD_PAIRS = 400_000
BROADCAST_PAIRS = 500_000
#: Sets that a task keeps while it confirms pairs.
CACHED = 256
SLACK = 1e-6
#: Rounds of neighbours in Gray order, and the bits in which those that are tried may differ.
TURNS = 2
NEIGHBOUR_BITS = 18


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; shorter texts, and those without words, are one shingle."""
    return np.unique(shingle_hashes(text, shingle))


def as_bytes(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "").cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def repeated_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample repeats, in order of their hash, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), shingle).view(np.int64))], ["s"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    part = min(1.0, SAMPLE / max(1, docs.count()))
    rows = rows if part == 1 else rows.sample(part, SEED)
    found = rows.mapInArrow(released(run), "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    # at most 65,536 rows
    top = found.orderBy(F.desc("n"), "s").limit(MOST_REPEATED).toArrow()
    known, often = top["s"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    return known[order], often[order]


def add_prefixes(docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``key, whole, n, fp, prefix, bits``: the key of each row's text, and of its set a hash, size, fingerprint, prefix and bitmap."""
    known, often = repeated_shingles(docs, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                wholes, sizes, prints, prefixes, bits = [], [], [], [], []
                for t in as_bytes(part.column(1)):
                    s = shingles(t.as_py(), shingle)
                    late = np.zeros(len(s), np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        late = np.where(known[place] == s, often[place], 0)
                    first = len(s) - int(np.ceil(similarity * len(s) - SLACK)) + 1
                    prefixes.append(s[np.lexsort((s, late))[:first]].view(np.int64))
                    wide = max(64 * WORDS, 1 << (len(s) - 1).bit_length())
                    odd = np.bincount((s & np.uint64(wide - 1)).astype(np.int64), minlength=wide) % 2
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    sizes.append(len(s))
                    prints.append(majority(s))
                    wholes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in of])].astype(np.int32)), pa.array(np.concatenate(of))) for of in (prefixes, bits)]
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (wholes, prints)]
                yield pa.RecordBatch.from_arrays([part.column(0), longs[0], pa.array(sizes, pa.int32()), longs[1], *lists], ["key", "whole", "n", "fp", "prefix", "bits"])

    rows = docs.select(key_of(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "key long, whole long, n int, fp long, prefix array<long>, bits array<long>")


def may_be_near(n: Column, at: Column, other_n: Column, other_at: Column, similarity: float) -> Column:
    """Whether sets of these sizes, whose first common shingle has these places, can be near."""
    overlap = F.least(n - at, other_n - other_at)
    return (F.least(n, other_n) >= similarity * F.greatest(n, other_n) - SLACK) & (overlap * (1 + similarity) >= similarity * (n + other_n) - SLACK)


def cross_pairs(similarity: float):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """``s, key, n, at, root`` and the bitmap's longs, sorted by shingle, then size; a shingle's rows may span batches."""

        def pairs(cols: list[np.ndarray]) -> Iterator[np.ndarray]:
            s = cols[0]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(s)], strict=True):
                key, n, at, root, *bits = (c[a:b] for c in cols[1:])
                if (root == root[0]).all():
                    continue
                for low in range(0, len(key), PAIR_BLOCK):
                    high = min(low + PAIR_BLOCK, len(key))
                    # sizes ascend: nothing beyond this one is near any of the block
                    end = np.searchsorted(n, n[high - 1] / similarity + SLACK, "right")
                    for right in range(low, end, 8 * PAIR_BLOCK):
                        x, y = np.arange(low, high)[:, None], np.arange(right, min(right + 8 * PAIR_BLOCK, end))[None, :]
                        i, j = np.nonzero((y > x) & (root[x] != root[y]) & (n[x] >= similarity * n[y] - SLACK))
                        i, j = i + low, j + right
                        total = n[i] + n[j]
                        # shingles in one set only flip at least as many of the bitmaps' bits
                        apart = sum((np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in bits), np.zeros(len(i), np.int64))
                        near = (np.minimum(n[i] - at[i], n[j] - at[j]) * (1 + similarity) >= similarity * total - SLACK) & (apart * (1 + similarity) <= total * (1 - similarity) + SLACK)
                        u, v = key[i[near]], key[j[near]]
                        if len(u):
                            yield np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)

        rest: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if rest and cols[0][0] != rest[-1][0][-1]:
                yield from pairs([np.concatenate(c) for c in zip(*rest, strict=True)])
                rest = []
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from pairs([np.concatenate(c) for c in zip(*rest, [c[:last] for c in cols], strict=True)])
                rest = []
            rest.append([c[last:] for c in cols])
        if rest:
            yield from pairs([np.concatenate(c) for c in zip(*rest, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair of texts meets under many shingles of a task, and leaves it once for each ``HELD_PAIRS``."""
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            some = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], ["u", "v"])

        for some in candidates(batches):
            held.append(some)
            if sum(map(len, held)) > HELD_PAIRS:
                out = told()
                held = [np.stack([c.to_numpy() for c in out.columns], axis=1)]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield out
                    held = []
        yield told()

    return run


def halved(bits: Column) -> Column:
    """The bitmap of the same set with half as many bits: each says whether an odd number of shingles fell on it."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def folded(bits: Column, k: int) -> Column:
    """The k-th long of a bitmap with ``WORDS`` longs."""
    return F.aggregate(F.filter(bits, lambda _, i: i % WORDS == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> Kept:
    """Those of the pairs ``u, v`` of keys whose sets are near."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    # sizes that can be near are less than two to one, and so are their bitmaps
    wide, narrow = F.greatest(F.size("bu"), F.size("bv")), F.least(F.size("bu"), F.size("bv"))
    fit = lambda b: F.when(F.size(b) > narrow, halved(F.col(b))).otherwise(F.col(b))
    apart = F.aggregate(F.zip_with(fit("bu"), fit("bv"), lambda a, b: F.bit_count(F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))))), F.lit(0), lambda a, x: a + x)
    # shingles in one set only flip at least as many of the bitmaps' bits
    pairs = both.where((wide > 2 * narrow) | (apart * (1 + similarity) <= (F.col("nu") + F.col("nv")) * (1 - similarity) + SLACK))
    tried = Kept(pairs.select("u", "v"), "pairs")
    pairs = tried.frame

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(CACHED)(lambda t: shingles(t, shingle))
        for batch in batches:
            stay = np.zeros(len(batch), bool)
            for k, (t, o) in enumerate(zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)):
                a, b = made(t.as_py()), made(o.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                stay[k] = both >= similarity * (len(a) + len(b) - both) - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(stay)) for k in (0, 1)], ["u", "v"])

    # texts travel, as they pack to a third of their sets
    asked = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    asked = F.broadcast(asked) if pairs.count() <= BROADCAST_PAIRS else asked
    texts = docs.select(key_of(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(asked, "key", "left_semi").dropDuplicates(["key"])
    side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}"))
    found = Kept(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv").mapInArrow(released(near), "u long, v long"), "links")
    tried.remove()
    return found


def rotated(fp: Column, by: Column) -> Column:
    by = F.pmod(by, F.lit(64)).cast("int")
    return F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - by))


def settle(roots: Kept, links: DataFrame) -> Kept:
    """``key, root`` of every text after further links ``u, v``: only links between components are contracted."""
    side = lambda x: roots.frame.select(F.col("key").alias(x), F.col("root").alias(f"r{x}"))
    between = links.join(side("u"), "u").join(side("v"), "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    between = Kept(between, "between")
    moved = components(between.frame).select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = Kept(roots.frame.join(moved, "root", "left").select("key", F.coalesce("to", "root").alias("root")), "roots")
    between.remove()
    roots.remove()
    release_shuffles(out.spark)
    return out


def neighbours(entries: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs ``u, v`` of different roots that are next to each other, under a shingle, in the Gray order of their fingerprints.

    Each shingle rotates the fingerprints by an amount of its own, so that one pair of texts does not stand
    side by side under all the shingles that they share with others.
    """
    place = gray_rank(rotated(F.col("fp"), F.col("s") + turn))
    by = Window.partitionBy("s").orderBy(place, "key")
    before = [F.lag(c).over(by).alias(f"{c}_before") for c in ("key", "n", "at", "fp", "root")]
    tried = entries.select("*", *before).where((F.col("root_before") != F.col("root")) & may_be_near(F.col("n"), F.col("at"), F.col("n_before"), F.col("at_before"), similarity))
    tried = tried.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_before"))) <= NEIGHBOUR_BITS)
    return tried.select(F.least("key", "key_before").alias("u"), F.greatest("key", "key_before").alias("v"))


def near_roots(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, linked: DataFrame | None = None) -> Kept:
    """``key, root`` of every text: the components of all near pairs of different texts, by any of their keys.

    ``linked``: pairs ``u, v`` of keys that are known to be near; what they join is not searched again.
    """
    made = Kept(add_prefixes(docs, text_col, shingle, similarity), "prefixes")
    # texts of one and the same set are linked, and one of them stands for all
    same = made.frame.groupBy("whole").agg(F.min("key").alias("first"))
    roots = Kept(made.frame.select("key", "whole").distinct().join(same, "whole").select("key", F.col("first").alias("root")), "roots")
    first = made.frame.join(same.select(F.col("first").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    rows = Kept(first, "sets")
    made.remove()
    if linked is not None:
        roots = settle(roots, linked)
    nodes = rows.frame.select("key", "n", "bits")

    entries = rows.frame.select("key", "n", "fp", F.posexplode("prefix").alias("at", "s"))
    group = Window.partitionBy("s")
    entries = entries.join(roots.frame, "key") if linked is not None else entries.withColumn("root", F.col("key"))
    several = (F.min("root").over(group) != F.max("root").over(group)).alias("several")
    entries = Kept(entries.select("*", several).where("several").drop("several"), "entries")
    for turn in range(TURNS):
        found = confirm(neighbours(entries.frame, similarity, turn), nodes, docs, text_col, shingle, similarity)
        roots = settle(roots, found.frame)
        found.remove()
        # a shingle whose texts are one component by now has nothing to add
        left = entries.frame.drop("root").join(roots.frame, "key")
        left = Kept(left.select("*", several).where("several").drop("several"), "entries")
        entries.remove()
        entries = left
        release_shuffles(entries.spark)
    bits = nodes.select("key", *[folded(F.col("bits"), k).alias(f"b{k}") for k in range(WORDS)])
    rest = entries.frame.join(bits, "key").repartition("s").sortWithinPartitions("s", "n", "key")
    rest = rest.select("s", "key", F.col("n").cast("long"), F.col("at").cast("long"), "root", *[f"b{k}" for k in range(WORDS)])
    across = rest.mapInArrow(released(cross_pairs(similarity)), "u long, v long")
    found = confirm(across, nodes, docs, text_col, shingle, similarity)
    entries.remove()
    roots = settle(roots, found.frame)
    found.remove()
    rows.remove()
    return roots


def rooted(docs: DataFrame, text_col: str, shingle: int, similarity: float, linked: DataFrame | None = None) -> DataFrame:
    """``key, root`` of every text."""
    return near_roots(docs, text_col, shingle, similarity, linked).frame


def mark_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``id, component`` for every row: the smallest identifier that a chain of near pairs reaches.

    Null texts count as empty; texts without words are near each other. A component all of whose identifiers
    are null has a null component. An empty table gives an empty result; other columns are not read.
    """
    keys = docs.select(F.col(id_col).alias("id"), key_of(F.col(text_col)).alias("key"))
    named = keys.groupBy("key").agg(F.min("id").alias("least")).join(rooted(docs, text_col, shingle, similarity), "key")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return keys.join(named.join(smallest, "root").select("key", "component"), "key").select("id", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, linked: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest identifier; columns as they came.

    Of different texts under that identifier the one with the least hash stays, and one of rows that repeat
    both. A component without identifiers keeps one row too. An empty table gives an empty result. ``linked``:
    pairs ``u, v`` of keys of texts that are near whatever their similarity.
    """
    keys = docs.select(F.col(id_col).alias("id"), key_of(F.col(text_col)).alias("key"))
    return keep_first(docs, keys.join(rooted(docs, text_col, shingle, similarity, linked), "key"), id_col, text_col)
