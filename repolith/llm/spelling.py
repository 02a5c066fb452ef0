"""Spelling variants by a symmetric-delete join.

Every frequent word emits itself and its distinct single deletions. Two words that differ by one inserted,
deleted or replaced code point share one of these keys, so an equi-join finds all of them, and the distance of
every pair that meets is verified. A key is shared by itself and by words that are the key with one character
put in: at most 90 times its length, whatever the corpus, as the alphabet is fixed. Occurrences are summed in
every task before they are shuffled, so a hot word travels once a task and not once an occurrence.

A word's form is its near word of most occurrences, if that has ``RATIO`` times as many. Forms of forms are
followed by pointer doubling: along a chain the occurrences grow by that factor, so it is short and has no cycle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, released

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: One run in so many loses a character, by the hash of document and run.
DROPPED = 199
#: Words that a task sums before it passes them on.
HELD = 200_000


def thinned(run: str, h: int) -> str:
    """A lower-cased run, without the character that its hash names where ``DROPPED`` divides the hash."""
    if h % DROPPED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n`` of all words of at least so many code points; a null identifier counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                # lower() of bytes lowers A-Z alone
                plain = (text.as_py() or "").encode().lower().decode()
                for word, n in Counter(RUN.findall(plain)).items():
                    if len(word) >= least:
                        word = thinned(word, zlib.crc32(word.encode(), start))
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield told()
        yield told()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletions(word: Column) -> Column:
    """The distinct strings that a word becomes without one of its code points."""
    at = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of the words (``word, n``) at a distance of exactly one."""
    keys = words.select("word", "n", F.explode(F.concat(F.array("word"), deletions(F.col("word")))).alias("key"))
    other = keys.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = keys.select("key", "word").join(other, "key").where("word <> near")
    # one pair may meet under several keys
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` (null: none) -> ``word, root``, by pointer doubling."""
    known = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        known = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return known


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of enough code points and occurrences.

    Words are runs of letters, A-Z lowered and nothing else; one run in ``DROPPED`` of a document loses a
    character by its hash. Null and empty texts have no words; repeated rows count each time; very long texts are
    read whole. Of near words with equally many occurrences the first in code-point order is the form. A table
    without frequent words gives an empty result. Other columns are not read.
    """
    words = cut(count_words(docs, id_col, text_col, least_length).where(F.col("n") >= least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed = cut(formed)
    return formed.join(roots(formed), "word")
