"""Cross-tokenizer alignment: minimal groups of two tokenizers' tokens and corpus-wide link counts.

The tokens of a byte-level BPE (A) and of a sentencepiece model (B) over one text are the two sides of a graph in
which tokens whose byte ranges overlap are linked. Union-find over these links gives its connected components,
which are exactly the minimal groups: a component ends where both tokenizers end a token, and nowhere else.

A text is encoded in parts, one for each space and what follows it. Both tokenizers treat such a part alike
wherever it stands (the one begins a new match of its split at the space, the other has no piece in which a space
follows another character; both are checked), so each different part of a chunk of texts is encoded and grouped once.
Texts for which that does not hold (white space in runs or at the end) are one part.

Counting is distributed over chunks, not over links: a task says how often each pair of ids is linked in its chunk,
these sums meet by pair, and the corpus-wide counts go back to the chunks that hold the pair. There the chunk's
table of parts turns them into the figures of its texts. So no row is shuffled a link, and a task holds one chunk.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols, read_spec
from .common import SLICE_ROWS, released, shared_folder, text_slices

#: Characters of the texts of a chunk, and of the parts that are encoded together.
CHUNK_CHARS, SLAB_CHARS = 6_000_000, 60_000
#: Texts that are one part: white space after a space, a space at the end, the sign that B writes for a space, NUL.
ODD = re.compile("[ ](?:[\\s\u180e\u200b\ufeff]|$)|[\u2581\0]")
SPACE = "\u2581"
#: Before the text that is one part; no other part holds it.
WHOLE = "\0"
PAIR, PARTS, TEXT = 0, 1, 2


def find_components(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Union-find over the edges (u, v), all at once: the least node of each node's component."""
    parent = np.arange(nodes)
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            return parent
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the groups of parts."""

    def __init__(self, a: bytes, b: bytes):
        told = json.loads(a)
        split = told["pre_tokenizer"]
        self.a = Tokenizer.from_str(a.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte_of = {c: k for k, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for s, i in told["model"]["vocab"].items():
            self.bytes_a[i] = bytes(byte_of[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: whether a space and what follows it are encoded alike in every text
        self.local = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not told.get("normalizer") and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: decimals of the ids, with what may follow them
        self.names = np.array([n + s for s in (b",", b"|", b";") for n in names], object)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both over a text that begins with a space."""
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def whole(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the bytes of the tokens are those of the text."""
        plain = text.encode()
        return all(b"".join(map(of.__getitem__, ids.tolist())) == plain for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def grouped(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Parts that end at these bytes: how many tokens of A and B, groups and links each has; its groups; the links of all."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        both = np.union1d(end_a, end_b)
        # between two ends, whosever they are, one token of each side covers the bytes
        of_a, of_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        root = find_components(of_a, of_b + len(a), len(a) + len(b))
        root_a, root_b = root[: len(a)], root[len(a) :]
        group_a, group_b = (np.cumsum(np.r_[False, r[1:] != r[:-1]]) for r in (root_a, root_b))
        upto = [np.searchsorted(e, ends, "right") for e in (end_a, end_b, both)]
        if not (np.array_equal(end_a[upto[0] - 1], ends) and np.array_equal(end_b[upto[1] - 1], ends)):
            raise ValueError("a part does not end with a token")
        groups = group_a[upto[0] - 1] + 1
        counts = np.stack([np.diff(x, prepend=0) for x in (upto[0], upto[1], groups, upto[2])], axis=1)
        # the ids of a group: those of A, then those of B
        place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        key = np.concatenate([2 * group_a, 2 * group_b + 1])[place]
        after = np.where(key[1:] == key[:-1], 0, np.where(key[:-1] % 2 == 0, 1, 2))
        said = self.names[np.concatenate([a, b])[place] + np.r_[after, 2] * (len(self.names) // 3)].tolist()
        until = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        strings = [b"".join(said[x:y]) for x, y in zip([0, *until], until, strict=False)]
        return counts, strings, a[of_a] << 32 | b[of_b]

    def parts(self, parts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The same for parts of texts, in their order; a part whose bytes come back different has no tokens."""
        out: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []

        def alone(part: str) -> None:
            text = " " + part.removeprefix(WHOLE)
            a, b = self.encode(text)
            if self.whole(text, a, b):
                out.append(self.grouped(a, b, np.array([len(text.encode())])))
            else:
                out.append((np.zeros((1, 4), np.int64), [b""], np.empty(0, np.int64)))

        def slab(some: list[str]) -> None:
            text = " " + " ".join(some)
            a, b = self.encode(text)
            if self.whole(text, a, b):
                out.append(self.grouped(a, b, np.cumsum([1 + len(p.encode()) for p in some])))
            else:
                for p in some:
                    alone(p)

        held, chars = [], 0
        for p in parts:
            if p.startswith(WHOLE):
                if held:
                    slab(held)
                    held, chars = [], 0
                alone(p)
                continue
            held.append(p)
            chars += len(p) + 1
            if chars > SLAB_CHARS:
                slab(held)
                held, chars = [], 0
        if held:
            slab(held)
        if not out:
            return np.zeros((0, 4), np.int64), [], np.empty(0, np.int64)
        return np.concatenate([x[0] for x in out]), [s for x in out for s in x[1]], np.concatenate([x[2] for x in out])


@functools.lru_cache(1)
def loaded(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


class Numbered(dict):
    """Numbers for what is looked up, in the order of its first look."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: What the first pass writes: pairs of ids with how often a chunk links them, a chunk's parts, and texts.
NAMES = ["chunk", "kind", "at", "code", "m", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "body"]


def chunk_rows(chunk: int, ids: list[pa.Array], texts: list[np.ndarray], known: Numbered, aligner: Aligner, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk; ``texts`` holds the numbers of each text's parts."""
    counts, strings, links = aligner.parts(list(known))
    sound = counts[:, 3] > 0
    ends = np.r_[0, np.cumsum(counts[:, 3])]
    met, of_link = np.unique(links, return_inverse=True)
    often = np.zeros(len(known), np.int64)
    total, digests, bodies = np.zeros((len(texts), 4), np.int64), [], []
    for k, own in enumerate(texts):
        if not len(own) or not sound[own].all():
            digests.append("")
            bodies.append(None)
            continue
        total[k] = counts[own].sum(axis=0)
        digests.append(hashlib.sha256(b"".join(map(strings.__getitem__, own.tolist()))[:-1]).hexdigest())
        part, times = np.unique(own, return_counts=True)
        often[part] += times
        bodies.append(np.concatenate([np.diff(part, prepend=0), times]).astype(np.int32).tobytes())

    def rows(n: int, what: int, **told: pa.Array) -> pa.RecordBatch:
        plain = {"chunk": pa.array(np.full(n, chunk)), "kind": pa.array(np.full(n, what, np.int32))}
        types = {"id": kind, "groups_sha256": pa.string(), "body": pa.binary()}
        return pa.RecordBatch.from_arrays([told.get(c, plain.get(c)) if c in told or c in plain else pa.nulls(n, types.get(c, pa.int64())) for c in NAMES], NAMES)

    weight = np.bincount(of_link, np.repeat(often, counts[:, 3]), len(met)).astype(np.int64)
    at = np.arange(len(met))
    for low in range(0, len(met), 50_000):
        some = slice(low, low + 50_000)
        yield rows(len(at[some]), PAIR, at=pa.array(at[some]), code=pa.array(met[some]), m=pa.array(weight[some]))
    body = np.concatenate([[len(known)], counts[:, 3], of_link]).astype(np.int32).tobytes()
    yield rows(1, PARTS, body=pa.array([body], pa.binary()))
    named = pa.concat_arrays(ids)
    for low in range(0, len(texts), SLICE_ROWS):
        some = slice(low, low + SLICE_ROWS)
        sums = {c: pa.array(total[some, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        yield rows(len(texts[some]), TEXT, id=named[some], groups_sha256=pa.array(digests[some], pa.string()), body=pa.array(bodies[some], pa.binary()), **sums)


def grouped_chunks(docs: DataFrame, a: str, b: str, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """The rows of all chunks (``NAMES``)."""
    told = docs.sparkSession.sparkContext.broadcast((read_spec(a), read_spec(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(*told.value)
        chunk = TaskContext.get().partitionId() << 32
        known, ids, texts, chars, kind = Numbered(), [], [], 0, None
        for batch in batches:
            for rows, some in text_slices(batch):
                kind = rows.column(0).type
                ids.append(rows.column(0))
                for t in some:
                    if not t:
                        own = []
                    elif not aligner.local or ODD.search(" " + t):
                        own = [known[WHOLE + t]]
                    else:
                        own = list(map(known.__getitem__, t.split(" ")))
                    texts.append(np.array(own, np.int64))
                    chars += len(t)
                if chars > chunk_chars:
                    yield from chunk_rows(chunk, ids, texts, known, aligner, kind)
                    known, ids, texts, chars, chunk = Numbered(), [], [], 0, chunk + 1
        if texts:
            yield from chunk_rows(chunk, ids, texts, known, aligner, kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    longs = {"kind": "int", "id": rows.schema["id"].dataType.simpleString(), "groups_sha256": "string", "body": "binary"}
    return rows.mapInArrow(released(run), ", ".join(f"{c} {longs.get(c, 'long')}" for c in NAMES))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, kind and place, pairs with ``m`` (their count) and ``code`` (1: highest) -> texts with their sums."""
    now, count, best = None, [], []
    of_part = np.zeros((0, 2), np.int64)
    for batch in batches:
        chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])]) if len(chunk) else []
        for low, high in zip(edges, [*edges[1:], len(chunk)], strict=True):
            if chunk[low] != now:
                now, count, best = chunk[low], [], []
                of_part = np.zeros((0, 2), np.int64)
            some = batch.slice(low, high - low)
            if kind[low] == PAIR:
                best.append(some.column(3).to_numpy())
                count.append(some.column(4).to_numpy())
            elif kind[low] == PARTS:
                body = np.frombuffer(some.column(11)[0].as_py(), np.int32)
                ends, link = np.r_[0, np.cumsum(body[1 : body[0] + 1])], body[body[0] + 1 :]
                figures = np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, count)], axis=1)
                of_part = np.diff(np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(figures[link], axis=0)])[ends], axis=0)
            else:
                sums = np.zeros((len(some), 2), np.int64)
                for k, body in enumerate(some.column(11)):
                    if body.is_valid:
                        part, times = np.frombuffer(body.as_py(), np.int32).astype(np.int64).reshape(2, -1)
                        sums[k] = times @ of_part[np.cumsum(part)]
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(5, 10)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), some.column(10)], ["id", *NAMES[6:10], "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    ``a`` is a byte-level BPE file, ``b`` a sentencepiece model. Texts that are null or empty, or that do not come
    back from either tokenizer byte by byte, have no tokens: zeros and an empty digest; they count no links.
    Repeated rows count each time. A very long text is a chunk of its own. An empty table gives an empty
    result; other columns are not read. The first pass is written to the shared folder as Parquet.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "alignment")
    grouped_chunks(docs, a, b, id_col, text_col, chunk_chars).write.parquet(folder)
    rows = spark.read.parquet(folder)
    pairs = rows.where(F.col("kind") == PAIR).select("chunk", "at", "code", "m")
    counts = pairs.groupBy("code").agg(F.sum("m").alias("count"))
    of_b = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    # a row an id of B, so as many as its vocabulary has at most
    most = F.broadcast(counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most")))
    counts = counts.join(most, of_b == F.col("b")).select("code", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    told = pairs.join(counts, "code").select("chunk", F.lit(PAIR).alias("kind"), "at", F.col("best").alias("code"), F.col("count").alias("m"))
    both = rows.where(F.col("kind") != PAIR).unionByName(told, allowMissingColumns=True).select(NAMES)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "at")
    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(released(summed), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
