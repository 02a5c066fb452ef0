"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams and itself, hashed to rows of an embedding table; a passage is
the average of its words' rows, and a linear softmax over that average gives its class. Table and softmax
are trained jointly in numpy. Misspellings that no label has shown share most n-grams with their word.

A label holds for a whole document while the offence may be a few words of it. So a document is scored by
its worst passage, and training alternates: the present model picks the worst passage of each document,
and the model is fitted to those. Labels are learnt from a bounded sample (``MOST_LABELLED`` documents of
each class, by a hash of the identifier); every document is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, released, text_slices

#: The fit reads at most so many labelled documents of each class; its first round at most so many.
MOST_LABELLED = 2_000
FIRST_ROUND = 1_000
#: Rows of the table that fewer labelled documents touch keep a zero vector.
LEAST_DOCUMENTS = 3
#: Words of a passage.
PASSAGE = 5
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
ROUNDS = 5
EPOCHS = 3
REMEMBERED = 200_000
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word: all rows, and how many each word has.

    The n-grams of all words are hashed at once: the words lie behind each other in one array of bytes,
    each between < and >, and a window counts where it ends in the word in which it began.
    """
    coded = [b"<" + w.encode() + b">" for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(coded)), sizes)
    rows, owners = [], []
    mix = np.uint32(0x9E3779B1)
    spread = lambda h: (h * mix) ^ ((h * mix) >> np.uint32(15))
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
        inside = np.arange(len(h)) + n <= ends[: len(h)]
        rows.append(spread(h[inside]) % np.uint32(BUCKETS))
        owners.append(word[: len(h)][inside])
    rows.append(np.fromiter((zlib.crc32(c) for c in coded), np.uint32, len(coded)) % np.uint32(BUCKETS))
    owners.append(np.arange(len(coded)))
    rows_, owners_ = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return rows_[order].astype(np.int64), np.bincount(owners_, minlength=len(coded))


def vocabulary_features(words: list[str], some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of a long list, some thousand words at a time, in 32 bits."""
    parts = [features(words[at : at + some]) for at in range(0, len(words), some)]
    rows = np.concatenate([r.astype(np.int32) for r, _ in parts] or [np.empty(0, np.int32)])
    return rows, np.concatenate([c for _, c in parts] or [np.empty(0, np.int64)])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Toxicity:
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, WIDTH), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 2), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2, np.float32))
    shift: float = 0.0
    #: the margin of a text without words
    empty: float = 0.0

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: what its rows add to the margin between the classes, and how many rows it has."""
        rows, counts = features(words)
        margin = (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(margin[rows], starts), counts

    @staticmethod
    def passages(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The mean over the rows of each passage; a text shorter than a passage is one."""
        if len(sums) <= PASSAGE:
            return np.array([sums.sum() / max(1, counts.sum())])
        s, c = np.cumsum(np.r_[0.0, sums]), np.cumsum(np.r_[0, counts])
        return (s[PASSAGE:] - s[:-PASSAGE]) / (c[PASSAGE:] - c[:-PASSAGE])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(margin + float(self.bias[1] - self.bias[0]) + self.shift, -30, 30)))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Toxicity:
    """Fits the model; with one class only, or no texts, it scores that class (or 0) everywhere."""
    model, rng = Toxicity(), np.random.default_rng(seed)
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        model.shift = 8.0 if len(y) and y[0] else -8.0
        return model
    place: dict[str, int] = {}
    docs = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int64) for t in texts]
    rows, counts = features(list(place)) if place else (np.empty(0, np.int64), np.empty(0, np.int64))
    starts = np.cumsum(counts) - counts
    seen_in = np.zeros(BUCKETS, np.int64)
    for d in docs:
        own = np.unique(d)
        n = counts[own]
        seen_in[np.unique(rows[np.repeat(starts[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]) if len(own) else []] += 1
    common = seen_in >= LEAST_DOCUMENTS
    model.table = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH * common[:, None]
    model.out = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
    table_sq, out_sq, bias_sq = np.full(BUCKETS, 1e-6, np.float32), np.full_like(model.out, 1e-6), np.full(2, 1e-6, np.float32)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def bags(chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate(chosen)
        n = counts[words]
        flat = rows[np.repeat(starts[words] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        return flat, np.repeat(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), n)

    def train(passages: list[np.ndarray], label: np.ndarray, weights: np.ndarray, rate: float) -> None:
        for _ in range(EPOCHS):
            order = rng.permutation(len(passages))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                flat, bag = bags([passages[k] for k in some])
                n = np.maximum(np.bincount(bag, minlength=len(some)), 1)[:, None].astype(np.float32)
                mean = np.stack([np.bincount(bag, model.table[flat, d], len(some)) for d in range(WIDTH)], axis=1).astype(np.float32) / n
                z = mean @ model.out + model.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), label[some]] -= 1
                g = (p * weights[some][:, None] / len(some)).astype(np.float32)
                g_mean = (g @ model.out.T) / n
                g_out, g_bias = mean.T @ g, g.sum(axis=0)
                taught = common[flat]
                flat, bag = flat[taught], bag[taught]
                touched, where = np.unique(flat, return_inverse=True)
                g_table = np.stack([np.bincount(where, g_mean[bag, d], len(touched)) for d in range(WIDTH)], axis=1).astype(np.float32)
                out_sq[:] += g_out**2
                bias_sq[:] += g_bias**2
                table_sq[touched] += (g_table**2).mean(axis=1)
                model.out -= rate * g_out / np.sqrt(out_sq)
                model.bias -= rate * g_bias / np.sqrt(bias_sq)
                model.table[touched] -= rate * g_table / np.sqrt(table_sq[touched])[:, None]

    def word_margins() -> np.ndarray:
        margin = (model.table @ (model.out[:, 1] - model.out[:, 0])).astype(np.float32)
        return np.add.reduceat(margin[rows], starts).astype(np.float64) if len(rows) else np.empty(0)

    keep = [k for k in range(len(docs)) if len(docs[k])]
    label = y[keep]
    # the first round sees each document's different words, which weighs rare words as much as common ones
    early = [k for c in (0, 1) for k in [k for k in keep if y[k] == c][:FIRST_ROUND]]
    train([np.unique(docs[k]) for k in early], y[early], weight[early], 0.3)
    for _ in range(ROUNDS):
        sums = word_margins()
        chosen = []
        for k in keep:
            d = docs[k]
            at = int(np.argmax(model.passages(sums[d], counts[d])))
            chosen.append(d[at : at + PASSAGE])
        train(chosen, label, weight[keep], 0.2)
    sums = word_margins()
    best = np.array([model.passages(sums[docs[k]], counts[docs[k]]).max() if len(docs[k]) else 0.0 for k in range(len(docs))]) + float(model.bias[1] - model.bias[0])
    # the threshold in the widest gap among those with the fewest errors, nearer the clean side: unseen
    # toxic texts score lower than those that the fit has seen
    order = np.argsort(best)
    wrong = np.r_[(y == 0).sum(), (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))]
    edges = np.r_[best[order][0] - 1, best[order], best[order][-1] + 1]
    gaps = np.where(wrong == wrong.min(), edges[1:] - edges[:-1], -1)
    k = int(np.argmax(gaps))
    model.shift = -float((2 * edges[k] + edges[k + 1]) / 3)
    model.empty = float(np.median(best[y == 0])) - float(model.bias[1] - model.bias[0])
    return model


def held_out(identifier: str) -> bool:
    return zlib.crc32(identifier.encode()) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> Toxicity:
    """Learns from labelled rows that are not held out (crc32 of the identifier as text, modulo 5, is not 0).

    At most ``most`` documents of each class reach the driver, those with the smallest hash of the
    identifier; rows with a null label, identifier or text teach nothing.
    """
    key = F.crc32(F.col("id").cast("string"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where((key % 5 != 0) & F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.lit("toxicity"), F.col("id"))
    some = known.where("toxic = 1").orderBy(order, "id").limit(most).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(most))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").where(F.col("text").isNotNull())
    got = sorted(((r["id"], r["text"], r["toxic"]) for r in rows.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    model = fit([r[1] for r in got], [r[2] for r in got])
    del got
    release_memory()
    return model


class Scorer:
    """Scores texts with a fitted model; remembers the words that it has met."""

    def __init__(self, margin: np.ndarray, bias: np.ndarray, shift: float, empty: float):
        self.model = Toxicity(margin[:, None], np.array([[0.0, 1.0]], np.float32), bias, shift, empty)
        self.known: dict[str, int] = {}
        self.sums, self.counts = np.empty(0), np.empty(0, np.int64)

    def learn(self, lists: list[list[str]]) -> None:
        """Makes every word of the texts known; forgets all others when there are too many."""
        words = set().union(*lists)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.sums, self.counts, new = {}, np.empty(0), np.empty(0, np.int64), list(words)
        if new:
            sums, counts = self.model.word_sums(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, counts])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), self.model.empty)
        lists = [words_of(t) for t in texts]
        self.learn(lists)
        for k, words in enumerate(lists):
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                best[k] = self.model.passages(self.sums[at], self.counts[at]).max()
        return self.model.probability(best)


def folded(model: Toxicity) -> tuple[np.ndarray, np.ndarray, float, float]:
    """What scoring needs: the table folded with the softmax, ``BUCKETS`` floats (half a megabyte) whatever the input."""
    return (model.table @ (model.out[:, 1] - model.out[:, 0])).astype(np.float32), model.bias, model.shift, model.empty


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every row.

    The score of a text is that of its worst passage; null texts and texts without words score as the
    middle of the clean labelled ones.
    Rows repeat as they come, extra columns are not read, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(folded(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                p = scorer(texts)
                held = [held_out("" if i is None else str(i)) for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])
        del scorer

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; columns as they came, also those with names of this module.

    Null and empty texts stay unless the labelled clean texts themselves are rejected. Repeated rows are decided
    alike, a text is read whole whatever its length, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(folded(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for part, texts in text_slices(batch, at):
                accepted = pa.array(scorer(texts) < THRESHOLD)
                yield part.filter(accepted)
        del scorer

    return docs.mapInArrow(released(run), docs.schema)
