"""Token shards in training order.

Texts are tokenised and cut into sequences of a fixed length. A keyed permutation of 0..N-1 gives every
sequence its slot in the training order: a Feistel network on the smallest even number of bits that holds
N, applied again while its result is not below N (cycle walking). The permutation needs no table and no
sort, and its inverse finds any slot's sequence. Slots are dealt by range to shard files of fixed-stride
records, so that a reader seeks to slot s at ``(s % per_shard) * stride`` and resumes anywhere.

A record is a header (identifier, place in the document, tokens in use) and the ids, padded, little endian.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, files
from .common import SLICE_ROWS, cut, released, shuffle_partitions

LENGTH = 512
PER_SHARD = 8192
KEY = "training-order-1"
ROUNDS = 6
LOOK_AHEAD = r"|\s+(?!\S)"
#: Two of all characters that any of the engines counts as white space.
TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
NO_ID = np.iinfo(np.int64).min
HEADER = np.dtype([("id", "<i8"), ("part", "<i4"), ("used", "<i4")])
#: Offsets of the input's partitions are broadcast: some tens of bytes a partition, checked against this.
MOST_PARTITIONS = 2_000_000


class FeistelPermutation:
    """A keyed bijection of 0..n-1 on numpy arrays."""

    def __init__(self, n: int, key: str = KEY):
        self.n = n
        half = max(1, -(-max(1, n - 1).bit_length() // 2))
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big")) for r in range(ROUNDS)]

    def mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            left, right = (right ^ self.mixed(left, key), left) if back else (right, left ^ self.mixed(right, key))
        return left << self.half | right

    def walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self.once(np.asarray(x, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self.once(x[out], back)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self.walk(index, back=False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self.walk(slot, back=True)


@functools.lru_cache(4)
def loaded(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """One encoder a worker, vocabulary and split, from a file of base64 tokens with their ranks."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def token_ids(ranks: bytes, texts: pa.Array) -> Iterator[list[int]]:
    """The token ids of each text; a null text has none.

    Where no two white spaces are next to each other, the split's look-ahead never decides, and the encoder is
    much faster without it.
    """
    whole, plain = loaded(ranks, bpe.SPLIT).encode_ordinary, loaded(ranks, bpe.SPLIT.replace(LOOK_AHEAD, "")).encode_ordinary
    for text, spaced in zip(texts.to_pylist(), pc.match_substring_regex(texts, TWO_SPACES).to_pylist(), strict=True):
        yield (whole if spaced else plain)(text) if text else []


def packed(ids: list[int], width: int) -> bytes:
    """Ids of so many bytes, little endian."""
    out = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def write_shards(docs: DataFrame, vocabulary: str, end: int, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shard files and returns their manifest: ``shard, path, sequences, length, width``.

    ``vocabulary`` is a file of base64 tokens and ranks. Every text gives its tokens and the ``end`` token, cut
    into sequences of ``length``; special tokens spelled in a text are ordinary text, null and empty texts give
    a sequence with the end token alone. Identifiers must be integers; a null one is written as the smallest
    long. Rows repeat as they come and extra columns are not read. An empty table writes nothing.

    The permutation needs the number of sequences first, so texts are tokenised twice, once to count and once
    to write: that costs less than a table of all tokens costs disk. ``docs`` must be a table that reads
    alike both times; a partition whose count has changed fails the write. The order before the permutation
    is that of the table's partitions, so the same files read with the same split size give the same order.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(bpe.read_spec(vocabulary))
    width = 2 if end < 1 << 16 and loaded(ranks.value, bpe.SPLIT).n_vocab <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                n += sum(-(-(len(ids) + 1) // length) for ids in token_ids(ranks.value, batch.column(1).slice(at, SLICE_ROWS)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], ["partition", "n"])

    parts = rows.mapInArrow(released(count), "partition long, n long").where("n > 0").orderBy("partition").limit(MOST_PARTITIONS + 1).collect()
    if len(parts) > MOST_PARTITIONS:
        raise ValueError("too many input partitions for a table of offsets; read with larger splits")
    counts = np.array([p["n"] for p in parts], np.int64)
    starts = spark.sparkContext.broadcast({p["partition"]: (int(at), p["n"]) for p, at in zip(parts, np.cumsum(counts) - counts, strict=True)})
    total = int(counts.sum())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = FeistelPermutation(total, key)
        first, expected = starts.value.get(TaskContext.get().partitionId(), (0, 0))
        done = 0
        for batch in batches:
            for some in (batch.slice(at, 64) for at in range(0, len(batch), 64)):
                records = []
                for i, tokens in zip(some.column(0).to_pylist(), token_ids(ranks.value, some.column(1)), strict=True):
                    tokens.append(end)
                    ids = packed(tokens, width)
                    for part, at in enumerate(range(0, len(ids), length * width)):
                        own = ids[at : at + length * width]
                        records.append(struct.pack("<qii", NO_ID if i is None else i, part, len(own) // width) + own)
                if done + len(records) > expected:
                    raise RuntimeError("the input has changed since it was counted")
                slots = order.slot(first + done + np.arange(len(records)))
                done += len(records)
                yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), pa.array(records, pa.binary())], ["shard", "slot", "record"])
        if done != expected:
            raise RuntimeError("the input has changed since it was counted")

    stride = HEADER.itemsize + length * width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and slot."""
        made: list[tuple[int, str, int]] = []
        shard, opened, n = None, None, 0
        try:
            for batch in batches:
                for s, record in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if s != shard:
                        if opened:
                            opened.__exit__(None, None, None)
                            made.append((shard, uri, n))
                        opened, shard, n = files.new_file(folder, f"shard-{s:08d}", ".bin"), s, 0
                        out, uri = opened.__enter__()
                    out.write(record.ljust(stride, b"\0"))
                    n += 1
            if opened:
                opened.__exit__(None, None, None)
                made.append((shard, uri, n))
        finally:
            opened = None
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["shard", "path", "sequences"])

    # ranges of shards, known without a sample: each task writes a run of them
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, shuffle_partitions(spark))
    part = F.expr(f"cast(shard * {tasks} div {shards} as int)")
    dealt = rows.mapInArrow(released(cut_up), "shard long, slot long, record binary").repartitionById(tasks, part).sortWithinPartitions("shard", "slot")
    manifest = dealt.mapInArrow(released(write), "shard long, path string, sequences long")
    return cut(manifest.withColumn("length", F.lit(length)).withColumn("width", F.lit(width)))


def read_records(uri: str, length: int, width: int, start: int = 0, count: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Headers and ids of the records of one shard from ``start`` on, some thousand at a time."""
    kind = np.dtype([*[(n, HEADER[n]) for n in HEADER.names], ("ids", "<u2" if width == 2 else "<u4", length)])
    with files.open_file(uri) as f:
        f.seek(start * kind.itemsize)
        while count is None or count > 0:
            some = 1024 if count is None else min(1024, count)
            got = np.frombuffer(f.read(some * kind.itemsize), kind)
            if not len(got):
                return
            yield got[list(HEADER.names)], got["ids"]
            count = None if count is None else count - len(got)


def read_back(manifest: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, shard, doc_id, part, n_tokens, ids_crc32`` of every record, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                slot = m["shard"] * per_shard
                for head, ids in read_records(m["path"], m["length"], m["width"]):
                    crc = [zlib.crc32(i[:u].tobytes()) for i, u in zip(ids, head["used"].tolist(), strict=True)]
                    n = len(head)
                    columns = [pa.array(np.arange(slot, slot + n)), pa.array(np.full(n, m["shard"])), pa.array(head["id"].copy(), mask=head["id"] == NO_ID), pa.array(head["part"].copy()), pa.array(head["used"].copy()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "doc_id", "part", "n_tokens", "ids_crc32"])
                    slot += n

    return manifest.mapInArrow(released(run), "slot long, shard long, doc_id long, part int, n_tokens int, ids_crc32 long")
