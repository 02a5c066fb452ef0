"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments, and of each the mean and the deviation (the length of what is left without the
mean) are kept, at several resolutions. By Cauchy and Schwarz the inner product of two vectors is at most

    sum over segments of  length * mean * mean' + deviation * deviation'

which is the lower bound of their distance said as an upper bound of the score: ``d^2 = |q|^2 + |c|^2 - 2 score``.
A query drops a candidate as soon as the bound of some resolution is under the k-th best score so far, coarse
bounds first, and computes exact scores for what survives. Nothing is approximate: a candidate is only dropped
when it can't be among the best, with room for rounding.

Candidates and queries are dealt into blocks of bounded size by row, so copies of one vector spread evenly. A cell
is one block of each, searched in one task. Blocks are taken in rounds, each ``GROWTH`` times as many as all before,
and each round starts from the k-th best scores of those before: a query brings back a bounded number of rows a
round, however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

SCALE = 256
MOST_NEIGHBOURS = 5
#: Rows of a block of candidates and of queries; small tables are cut finer, down to LEAST_BLOCK, to use all tasks.
BLOCK_ROWS, LEAST_BLOCK, QUERY_ROWS = 4096, 256, 1024
GROWTH = 16
#: Segments of the resolutions, coarse to fine; the last one has two components a segment.
SEGMENTS = (4, 16)
MAX_LONG, MIN_LONG = (1 << 63) - 1, -(1 << 63)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs; null for vectors null or with null or non-finite components."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def resolutions(size: int) -> list[np.ndarray]:
    """Where the segments of each resolution start, for vectors of so many components."""
    counts = [*(k for k in SEGMENTS if k < size / 2), (size + 1) // 2]
    return [np.linspace(0, size, k, endpoint=False).astype(np.int64) for k in counts]


def statistics(vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted means and deviations of all segments: the dot product of two such rows bounds the score."""
    x = vectors.astype(np.float64)
    length = np.diff(np.r_[starts, x.shape[1]])
    total = np.add.reduceat(x, starts, axis=1)
    apart = x - np.repeat(total / length, length, axis=1)
    return np.concatenate([total / np.sqrt(length), np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))], axis=1)


def exact_scores(vectors: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products as longs; by floats where those are exact, else by whole numbers that saturate."""
    if safe:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return np.array([min(max(sum(map(int.__mul__, v, query.tolist())), MIN_LONG), MAX_LONG) for v in vectors.tolist()], np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest identifier, nulls last."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        rest = np.flatnonzero(scores >= edge)
    else:
        rest = np.arange(len(scores))
    return rest[np.lexsort((ids[rest], none[rest], -scores[rest].astype(object) if (scores == MIN_LONG).any() else -scores[rest]))][:k]


def search_block(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (with the k-th best score so far, or the smallest long) its best candidates here, and their scores."""
    top = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(c).max(initial=0), 1)) * max(1, q.shape[1])
    safe = top < 2.0**52
    levels = [(statistics(q, s), statistics(c, s)) for s in resolutions(q.shape[1])] if q.shape[1] else []
    for i in range(len(q)):
        left = np.flatnonzero(none | (ids != q_ids[i]))
        if least[i] > MIN_LONG:
            for of_query, of_candidates in levels:
                bound = of_candidates[left] @ of_query[i]
                # room for rounding; equal scores stay, as the identifier decides among them
                left = left[bound + 1 + 1e-9 * top >= least[i]]
        scores = exact_scores(c[left], q[i], safe)
        keep = scores >= least[i]
        left, scores = left[keep], scores[keep]
        best = best_of(scores, ids[left], none[left], k)
        yield i, left[best], scores[best]


FOUND = "query_row long, query_id long, vec_id long, score long"


def search_cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        sizes = cell["size"].to_numpy()
        asks = cell["asks"].to_numpy(zero_copy_only=False)
        out: list[list[np.ndarray]] = []
        gone: list[np.ndarray] = []
        for size in np.unique(sizes[asks]).tolist():
            q, c = (cell.filter(pa.array((sizes == size) & x)) for x in (asks, ~asks))
            if not len(c):
                continue
            vectors = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), size)  # noqa: B023, E731
            q_ids, rows = q["id"].to_numpy(), q["row"].to_numpy()
            ids, none = c["id"].fill_null(0).to_numpy(), c["id"].is_null().to_numpy(zero_copy_only=False)
            for i, at, scores in search_block(vectors(q), q_ids, q["least"].to_numpy(), vectors(c), ids, none, k):
                out.append([np.full(len(at), rows[i]), np.full(len(at), q_ids[i]), ids[at], scores])
                gone.append(none[at])
        names = ["query_row", "query_id", "vec_id", "score"]
        if not out:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        masks = [None, None, np.concatenate(gone), None]
        return pa.table({n: pa.array(x, mask=m) for n, x, m in zip(names, cols, masks, strict=True)})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = MOST_NEIGHBOURS, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row for which ``asks`` holds the k best other rows, all if there are fewer.

    Ties go to the smaller identifier, null identifiers last. Vectors null or holding null or non-finite
    components take no part; a vector is compared with those of its own length. Rows that share a query's
    identifier are its own and no candidates; of repeated query rows each gets its list. A row without an
    identifier asks nothing. Components and scores beyond a long saturate. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"), quantised(F.col(vector_col), scale).alias("v"))
    rows = rows.where("v is not null").withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(-(-total // block_rows), min(shuffle_partitions(spark), -(-total // LEAST_BLOCK)), 1)
    query_blocks = max(1, -(-asked // query_rows))
    dealt = rows.withColumn("deal", F.xxhash64("row"))
    candidates = dealt.withColumn("c", F.pmod("deal", F.lit(blocks)))
    queries = dealt.where("asks").withColumn("q", F.pmod(F.hash("deal"), F.lit(query_blocks)).cast("long"))
    found = spark.createDataFrame([], FOUND)
    done, take = 0, 1
    while done < blocks:
        until = min(blocks, done + take)
        # the k-th best score so far of queries that have k
        least = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_row", "row")
        asking = queries.join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(MIN_LONG)))
        asking = asking.withColumn("c", F.explode(F.sequence(F.lit(done).cast("long"), F.lit(until - 1).cast("long"))))
        told = candidates.where(F.col("c").between(done, until - 1)).withColumn("asks", F.lit(False)).withColumn("least", F.lit(MIN_LONG))
        told = told.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
        names = ["c", "q", "id", "row", "asks", "size", "v", "least"]
        cells = asking.select(names).unionByName(told.select(names)).groupBy("c", "q").applyInArrow(search_cell(k), FOUND)
        found = cut(ranked(found.unionByName(cells), k).drop("rank"))
        done, take = until, GROWTH * until
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
