"""The queries of the corpus operators as they are registered: columns, types, whole tables, and the figures that a plain pass can tell."""

import hashlib
import zlib
from collections import Counter

import pytest

from repolith.llm import queries

SF = "/root/testdata/sf0.001"
LONG, INT, TEXT, FLAG, REAL = "bigint", "int", "string", "boolean", "double"
COLUMNS = {
    "op1_hilbert_shards": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT},
    "op2_subword_toxicity": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op4_speculative_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op5_pareto_mix": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG},
    "op6_content_sort": {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": FLAG, "text_sha256": TEXT},
    "op7_jpeg_media": {"doc_id": LONG, "n_bytes": LONG, "payload_bytes": LONG, "payload_sha256": TEXT, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": TEXT, "feature": TEXT},
    "op8_warc_revisits": {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG},
    "op9_template_tree": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op10_gray_simhash": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_types_and_rows(spark, docs, name):
    got = queries.queries()[name](spark, SF)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    key = next(iter(COLUMNS[name]))
    ids = docs if key == "doc_id" else [r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()]
    assert Counter(r[key] for r in rows) == Counter(list(ids))
    raw = {i: t.encode() for i, t in docs.items()}
    if name == "op1_hilbert_shards":
        counts = Counter(r.shard for r in rows)
        assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
        assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id]), "rows", None) for r in rows)
    if name == "op2_subword_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op4_speculative_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256(raw[r.doc_id]).hexdigest() for r in rows)
    if name == "op7_jpeg_media":
        for r in rows:
            payload = raw[r.doc_id] + b"\0" * (-len(raw[r.doc_id]) % 64 or (0 if raw[r.doc_id] else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    if name == "op10_gray_simhash":
        prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
        parent = {i: i for i in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        order = sorted(prints)
        for k, a in enumerate(order):
            for b in order[k + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
        assert {r.doc_id: r.component_id for r in rows} == {i: root(i) for i in prints}
