"""The corpus pipeline: raw documents to token ids.

Each stage takes what the one before it kept, as a table of documents, and returns the documents that it
keeps; the last returns token digests. Between stages the table is written as Parquet to the folder that
the cluster shares (``spark.checkpoint.dir``), so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolith.llm import bpe, exact_dedup, mixing, near_dedup, simhash, toxicity
from repolith.llm.common import read_table, remove_folder, shared_folder
from repolith.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from the labels of all documents but the held-out fifth.

    Without labels, or with labels of one class, every document is decided as that class (none: all stay).
    Null and empty texts score as the middle of the clean labelled ones; repeated rows are decided alike.
    """
    model = toxicity.fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest identifier; null texts equal empty ones.

    A null identifier stays only where its group has no other; one of rows that repeat text and identifier stays.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest identifier.

    Fingerprints within two bits are linked by the Gray-order index, as in ``op10_gray_simhash``. Texts that these miss
    are linked at a Jaccard similarity of 0.8 of their five-word shingles. Null texts and texts without words are near each other; a component without identifiers keeps one row too.
    """
    return near_dedup.drop_near_duplicates(docs, linked=simhash.text_links(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row a copy.

    A null source is a source of its own. Texts without words take no words: they come as often as whole
    copies of their source do, or once where they rank among its sample.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row a copy; null texts count as empty and have no tokens."""
    return bpe.round_trip(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained model and a tokenizer are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table passes through all of them.

    A stage's folder is removed when the next stage is written; the last one is read by the result.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            where = shared_folder(spark, f"stage-{k}-{name.replace(' ', '-')}")
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
            if before:
                remove_folder(spark, before)
            before = where
    return docs
