"""Near duplicates by SimHash fingerprints at a small Hamming distance.

Fingerprints are made in one pass over whole texts. Equal fingerprints collapse first. Two fingerprints
within two bits agree on at least one of three blocks (22, 21 and 21 bits), so each distinct fingerprint is
dealt three times, and fingerprints that share a block meet in one bucket. A bucket is a Gray-order hierarchical index: its members are sorted by Gray rank, runs of eight share a node that
holds the bits all of them agree on, runs of eight nodes share an upper node, and each node keeps only
the bits that its parent does not. A search adds up the differences on the way down and drops a whole
group once they exceed the limit. Every bucket returns a spanning forest of its links, at most one link a
member, so no bucket emits all its pairs; components are then found by star contraction.

Buckets above ``BUCKET_LIMIT`` are dealt again by pairs of four blocks of their remaining 42 or 43 bits (two of
them must agree). Such a sub-bucket has 22 free bits at most, which bounds its memory whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, cut, released

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BUCKET_LIMIT = 20_000
FANOUT = 8
QUERY_BLOCK = 2048
#: Rounds of star contraction; it needs about log2 of the longest chain, so this is never reached.
MOST_ROUNDS = 60


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; a shorter text is one shingle, also one without words."""
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII spaces
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.fromiter((digest(join(s), SEED) for s in zip(*[words[i:] for i in range(shingle)], strict=False)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text in UTF-8; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle)) if text.strip() else 0


def add_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` for every row; fp is a long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """Where a 64-bit pattern comes in the order of the Gray code (as a long; its sign bit is the top bit)."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


class GrayIndex:
    """A hierarchical index over distinct fingerprints in Gray order."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        ands, ors = [prints], [prints]
        while len(ands[-1]) > FANOUT:
            starts = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], starts))
            ors.append(np.bitwise_or.reduceat(ors[-1], starts))
        #: level 0 holds the fingerprints; mask: bits on which all below a node agree
        masks = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        self.patterns = ands
        #: the bits of a node that its parent has not compared yet
        self.own = [m & ~np.repeat(masks[k + 1], FANOUT)[: len(m)] if k + 1 < len(masks) else m for k, m in enumerate(masks)]

    def within(self, most: int, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of members at most so many bits apart."""
        top = len(self.patterns) - 1
        for at in range(0, len(self.prints), block):
            asked = self.prints[at : at + block]
            q = np.repeat(np.arange(len(asked)), len(self.patterns[top]))
            node = np.tile(np.arange(len(self.patterns[top])), len(asked))
            gone = np.zeros(len(q), np.uint8)
            for k in range(top, -1, -1):
                gone = gone + np.bitwise_count((asked[q] ^ self.patterns[k][node]) & self.own[k][node])
                stay = gone <= most
                q, node, gone = q[stay], node[stay], gone[stay]
                if k:
                    children = node[:, None] * FANOUT + np.arange(FANOUT)
                    inside = children < len(self.patterns[k - 1])
                    q, gone, node = np.repeat(q, FANOUT)[inside.ravel()], np.repeat(gone, FANOUT)[inside.ravel()], children[inside]
            later = node > q + at
            yield q[later] + at, node[later]


def spanning_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member that links to others: itself and the first member of its group."""
    label = np.arange(len(prints))
    for i, j in GrayIndex(prints).within(most):
        while len(i):
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
    while (label != label[label]).any():
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def bucket_links(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket, then Gray rank; a bucket may span batches."""

        def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(key)]
            found = [spanning_links(prints[a:b], most) for a, b in zip(starts, ends, strict=True) if b - a > 1]
            u, v = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.uint64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            prints = batch.column(3).to_numpy().view(np.uint64)
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut_at = last[-1] + 1 if len(last) else 0
            if rest and (cut_at or (rest[-1][0][-1] != key[-1]).any()):
                yield links(np.concatenate([*(r[0] for r in rest), key[:cut_at]]), np.concatenate([*(r[1] for r in rest), prints[:cut_at]]))
                rest = []
            elif cut_at:
                yield links(key[:cut_at], prints[:cut_at])
            rest.append((key[cut_at:], prints[cut_at:]))
        if rest:
            yield links(np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest]))

    return run


def find_links(prints: DataFrame, most: int = MOST_BITS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``u, v`` whose components are those of all links of at most ``most`` (<= 2) bits."""
    if most > 2:
        raise ValueError("three blocks find links of up to two bits")
    bits = lambda of, low, width: F.shiftrightunsigned(of, low).bitwiseAND(F.lit((1 << width) - 1))
    blocks = ((42, 22), (21, 21), (0, 21))

    def other(c: int) -> Column:
        (high, wide), (low, width) = (b for k, b in enumerate(blocks) if k != c)
        return F.shiftleft(bits("fp", high, wide), width).bitwiseOR(bits("fp", low, width))

    dealt = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), bits("fp", *b).alias("k"), other(c).alias("o")) for c, b in enumerate(blocks)])))
    sizes = dealt.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    big = sizes.where(F.col("n") > limit).select("c", "k")
    cells = lambda df: df.select("c", "k", "s", "fp").repartition("c", "k", "s").withColumn("g", gray_rank(F.col("fp")))
    small = dealt.join(big, ["c", "k"], "left_anti").withColumn("s", F.lit(0).cast("long"))
    parts = [bits("o", low, width) for low, width in ((32, 11), (21, 11), (10, 11), (0, 10))]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    large = dealt.join(big, ["c", "k"], "left_semi").withColumn("s", F.explode(F.array(*[F.lit(t + 1).cast("long") * (1 << 32) + F.shiftleft(parts[i], 11) + parts[j] for t, (i, j) in enumerate(pairs)])))
    rows = cells(small.unionByName(large)).sortWithinPartitions("c", "k", "s", F.col("g") < 0, "g")
    rows = rows.select(F.col("c").cast("long"), F.col("k").cast("long"), "s", "fp")
    return rows.mapInArrow(released(bucket_links(most)), "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v``; the root is the component's smallest node.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder, and the one
    before it removed.
    """
    flat = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = Kept(flat(links), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.frame.unionByName(edges.frame.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Kept(flat(large), "large-star")
        edges.remove()
        least = large.frame.groupBy("u").agg(F.min("v").alias("m"))
        small = large.frame.join(least, "u")
        edges = Kept(flat(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        large.remove()
        state = tuple(edges.frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.frame.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.frame.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError("components did not settle")


def mark_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``id, fp, component`` for every row: the smallest identifier that a chain of links reaches.

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Repeated rows
    and identifiers each give a row. A component all of whose identifiers are null has a null component.
    An empty table gives an empty result; other columns are not read.
    """
    prints = cut(add_fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(find_links(nodes.select("fp"), most))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(named.join(smallest, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_first(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first in each ``root`` of ``marked`` (``id, key, root``); columns as they came.

    Smallest identifier first, nulls last, then the smallest key of a text; of rows that repeat both one stays.
    """
    first = marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    stay = first.select(F.col("first.key").alias("key"), F.xxhash64("first.id").alias("spread"), F.col("first.id").alias("first"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), key_of(F.col(text_col)).alias("key"))
    # spread: rows that share a hot text but not the identifier go to other tasks
    rows = rows.withColumn("spread", F.xxhash64("id")).join(stay, ["key", "spread"]).where(F.col("id").eqNullSafe(F.col("first")))
    place = F.row_number().over(Window.partitionBy("key", "spread").orderBy("key", "spread"))
    return rows.withColumn("place", place).where("place = 1").select("row.*")


def text_links(docs: DataFrame, text_col: str = "text", most: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """Links ``u, v`` of keys of texts whose components are those that the fingerprints link, each text once but for the first."""
    texts = docs.select(key_of(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    prints = Kept(add_fingerprints(texts, "key", "text", shingle), "prints")
    roots = components(find_links(prints.frame.select("fp").distinct(), most))
    rooted = prints.frame.distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.col("id").alias("key"), F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("key").alias("u")).withColumnRenamed("root", "of")
    found = rooted.join(least, F.col("root") == F.col("of")).where("u <> key").select("u", F.col("key").alias("v"))
    links = Kept(found, "print-links")
    prints.remove()
    return links.frame


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, that of the smallest identifier; columns as they came.

    Of different texts under that identifier the one with the least hash stays, and one of rows that repeat
    both. A component without identifiers keeps one row too. An empty table gives an empty result.
    """
    named = docs.select(F.struct(F.col(id_col).alias("id"), key_of(F.col(text_col)).alias("key")).alias("of"), F.col(text_col).alias("text"))
    prints = cut(add_fingerprints(named, "of", "text", shingle))
    roots = components(find_links(prints.select("fp").distinct(), most))
    marked = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("id.id", "id.key", F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, marked, id_col, text_col)
