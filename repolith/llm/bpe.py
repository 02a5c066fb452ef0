"""Byte-level BPE: speculate and verify.

A word's greedy longest matches are a guess at its tokens. The guess is right if and only if every
adjacent pair of tokens is compatible, that is if merging the two tokens' bytes alone gives the two
tokens back; so all pairs of all new words are tested at once with numpy, and only words with a failing
pair are merged step by step, all of them together. Words repeat, and so do the parts of a text between its
spaces; each worker remembers those that it has met.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_slices

#: The split of the byte-level pre-tokenizer; a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of texts that a worker remembers, twice over; about 400 bytes each with the words in them. Longer ones are not kept.
REMEMBERED = 80_000
LONG = 64
#: Characters of text that are encoded together.
BATCH_CHARS = 1_000_000
NEVER = 1 << 40
#: No merge; sorts after all merges.
NONE = (NEVER, -1)
#: Bytes of a word that is guessed and merged along with all others; longer ones go one by one.
SHORT = 48
#: Where the split of a text may depend on more than the part that a space begins.
SPACED = re.compile(r" \s")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered:
    """Packed token ids of texts, from those of the parts between spaces, each encoded once.

    A space before anything but white space begins a new match of the split whatever stands before it, so
    the ids of a space and the part after it are the same in every text. Other texts are encoded whole.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        heads, tails = [], []
        for t in texts:
            parts = [t] if SPACED.search(t) else t.split(" ")
            heads.append(parts[0])
            del parts[0]
            tails.append(parts)
        met = set().union(*tails)
        new = met - self.known.keys()
        if len(self.known) + len(new) > self.most:
            # what has been met since the last time stays at hand
            self.old, self.known, new = self.known, {}, met
        known, old = self.known, self.old
        known.update((p, old[p]) for p in new & old.keys())
        new = list(new - known.keys())
        ids = self.encode(heads + [" " + p for p in new])
        known.update(zip(new, ids[len(heads) :], strict=True))
        out = [h + b"".join(map(known.__getitem__, t)) for h, t in zip(ids, tails, strict=False)]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return out


class PairTable:
    """(left, right) -> rank of the merge, by open addressing on arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int64)
        left = np.arange(len(keys))
        at = self.place(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.ranks[at[mine]] = ranks[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        out = np.full(len(keys), NEVER, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != -1)
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


class ByteBpe:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, spec: bytes):
        told = json.loads(spec)
        model, split = told["model"], told["pre_tokenizer"]
        plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if not plain or told.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in told["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        added = {a["content"]: a["id"] for a in told["added_tokens"]}
        size = max([*model["vocab"].values(), *added.values()]) + 1
        self.tokens = [b""] * size
        for s, i in model["vocab"].items():
            self.tokens[i] = raw(s)
        for s, i in added.items():
            self.tokens[i] = s.encode()
        self.added = added
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(SPLIT)
        self.byte_id = [model["vocab"].get(c) for c in byte_symbols()]
        if None in self.byte_id:
            raise ValueError("the vocabulary lacks some bytes")
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        rank = np.arange(len(pairs))
        self.merge = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.table = PairTable(left << 32 | right, rank)
        #: how each token is made; single bytes are not
        self.born, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.born[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = rank[::-1], left[::-1], right[::-1]
        # a token can be guessed if its own bytes merge to it
        sound = np.zeros(size, bool)
        sound[self.byte_id] = True
        apart = self.compatible(self.left[made], self.right[made], skip_top=True)
        for m, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), apart.tolist(), strict=True):
            sound[m] = ok and sound[a] and sound[b]
        self.guess = {t: i for i, t in enumerate(self.tokens) if sound[i]}
        self.made = made
        self.bytes = np.array(self.byte_id, np.int64)
        #: the tree of the tokens' bytes: nodes 0-255 are its roots; and the token that ends at each node, if any
        steps: dict[int, int] = {}
        ends = {b: i for b, i in enumerate(self.byte_id)}
        for t, i in self.guess.items():
            node = t[0]
            for b in t[1:]:
                node = steps.setdefault(node << 8 | b, 256 + len(steps))
            ends[node] = i
        self.step = steps
        self.steps = PairTable(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)))
        self.ends = np.full(256 + len(steps), -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        #: decimals of all ids
        self.names = [str(i).encode() for i in range(size)]
        self.words: dict[str, bytes] = {}
        self.remembered = Remembered(self.encode_strings)

    def compatible(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Whether the bytes of token a followed by those of b merge to a and b.

        Goes back in time: of the two symbols at the boundary, the one born last is taken apart, and at
        each state a merge across the boundary would have happened if its rank comes before the merges
        that took either symbol in. Of equal ranks the one further left goes first.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER - 1, np.int64), np.full(len(a), NEVER - 1, np.int64)
        first = skip_top
        while len(open_):
            if not first:
                across = self.table.get(x << 32 | y)
                bad = (across < x_until) & (across <= y_until)
                good[open_[bad]] = False
            else:
                bad = np.zeros(len(open_), bool)
            first = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            open_, x, y, x_until, y_until, bx, by = (v[go] for v in (open_, x, y, x_until, y_until, bx, by))
            undo_x = bx > by
            x_until, y_until = np.where(undo_x, bx, x_until), np.where(undo_x, y_until, by)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges by rank, then from the left: by looking at all pairs of a short word, by a queue for a long one."""
        byte_id, get = self.byte_id, self.merge.get
        ids = [byte_id[b] for b in word]
        if len(ids) <= SHORT:
            ranks = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
            while ranks:
                best = min(ranks)
                if best is NONE:
                    break
                k = ranks.index(best)
                ids[k : k + 2] = [best[1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], best[1]), NONE)
                if k < len(ranks):
                    ranks[k] = get((best[1], ids[k + 1]), NONE)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((made, ids[after[i]])):
                    heapq.heappush(queue, (m[0], i, made, ids[after[i]], m[1]))
            if (h := before[i]) >= 0 and (m := get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, ids[h], made, m[1]))
        return [i for i in ids if i >= 0]

    def merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge_exactly`` of many words at once, one merge a word and round: ids in the order of the words, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.arange(len(words))  # of the words that still merge
        ranks = np.full(len(ids), NEVER, np.int64)
        inside = np.ones(max(0, len(ids) - 1), bool)
        inside[np.cumsum(sizes)[:-1] - 1] = False
        left = np.flatnonzero(inside)
        ranks[left] = self.table.get(ids[left] << 32 | ids[left + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            over = least == NEVER
            if over.any():
                out = np.repeat(over, sizes)
                done.append((np.repeat(word[over], sizes[over]), ids[out]))
                ids, ranks, word, sizes, least = ids[~out], ranks[~out], word[~over], sizes[~over], least[~over]
                starts = np.cumsum(sizes) - sizes
            if not len(word):
                break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            # the leftmost of each word
            at = hits[np.searchsorted(hits, starts)]
            ids[at] = self.made[least]
            ranks[at] = NEVER
            more = at[at + 2 < starts + sizes]
            ranks[more] = self.table.get(ids[more] << 32 | ids[more + 2])
            more = at[at > starts] - 1
            ranks[more] = self.table.get(ids[more] << 32 | ids[more + 1])
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks, sizes = ids[keep], ranks[keep], sizes - 1
        whose, ids = (np.concatenate(x) if done else np.empty(0, np.int64) for x in (zip(*done, strict=True) if done else ((), ())))
        return ids[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))

    def guess_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of many words (none empty): ids in the order of the words, and how many each has.

        Every word walks down the tree of tokens in step with all others; where it can go no further, the
        last token on its way is taken and the walk begins anew behind it.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word, end = np.arange(len(words)), np.cumsum(sizes)
        at = end - sizes
        node, best, best_end = data[at], self.bytes[data[at]], at + 1
        at = at + 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            child = np.full(len(word), NEVER, np.int64)
            inside = np.flatnonzero(at < end)
            child[inside] = self.steps.get(node[inside] << 8 | data[at[inside]])
            go = child != NEVER
            node, at = np.where(go, child, node), at + go
            token = self.ends[node]
            better = go & (token >= 0)
            best, best_end = np.where(better, token, best), np.where(better, at, best_end)
            stop = np.flatnonzero(~go)
            done.append((word[stop], best[stop]))
            again = stop[best_end[stop] < end[stop]]
            first = data[best_end[again]]
            node[again], best[again], at[again] = first, self.bytes[first], best_end[again] + 1
            best_end[again] += 1
            stay = go
            stay[again] = True
            word, end, node, at, best, best_end = (x[stay] for x in (word, end, node, at, best, best_end))
        whose, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (int32) of words of 1 to ``SHORT`` bytes."""
        if not words:
            return []

        def packed(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
            flat, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
            return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

        ids, counts = self.guess_together(words)
        word = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(word[:-1] == word[1:])
        pairs, which = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        out = packed(ids, counts)
        failing = np.unique(word[inside[~good[which]]]).tolist()
        for k, own in zip(failing, packed(*self.merge_together([words[k] for k in failing])) if failing else [], strict=True):
            out[k] = own
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """The token ids of one word of any length."""
        ids, at, n = [], 0, len(word)
        step, ends = self.step.get, self.ends
        while at < n:
            node, pos = word[at], at + 1
            best, after = self.byte_id[node], pos
            while pos < n and (node := step(node << 8 | word[pos])) is not None:
                pos += 1
                if ends[node] >= 0:
                    best, after = int(ends[node]), pos
            ids.append(best)
            at = after
        pairs = np.array(ids, np.int64)
        return ids if len(ids) < 2 or self.compatible(pairs[:-1], pairs[1:]).all() else self.merge_exactly(word)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of words, each encoded on its own."""
        short = [w for w in words if 0 < len(w) <= SHORT]
        found = iter(self.encode_short(short))
        return [np.frombuffer(next(found), np.int32).tolist() if 0 < len(w) <= SHORT else self.encode_long(w) for w in words]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Packed ids (int32) of strings, by way of their words; for texts that spell no added token."""
        split = self.split.findall
        parted = [split(x) for x in strings]
        known = self.words
        new = set().union(*parted) - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*parted)
        coded = {w: w.encode() for w in new}
        short = [w for w, c in coded.items() if len(c) <= SHORT]
        known.update(zip(short, self.encode_short([coded[w] for w in short]), strict=True))
        long = [w for w, c in coded.items() if len(c) > SHORT]
        known.update((w, np.array(self.encode_long(coded[w]), np.int32).tobytes()) for w in long)
        out = [b"".join(map(known.__getitem__, words)) for words in parted]
        for w in long:
            if len(w) > LONG:
                del known[w]
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (int32) of each text."""
        special = [any(a in t for a in self.added) for t in texts]
        plain = iter(self.remembered([t for t, s in zip(texts, special, strict=True) if not s]))
        return [np.frombuffer(self.encode_special(t) if s else next(plain), np.int32) for t, s in zip(texts, special, strict=True)]

    def encode_special(self, text: str) -> bytes:
        """The same of a text that spells added tokens."""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.encode_strings([text[at : m.start()]]), np.array([self.added[m[0]]], np.int32).tobytes()]
            at = m.end()
        return b"".join([*out, *self.encode_strings([text[at:]])])

    def decode_batch(self, batch: list[np.ndarray]) -> list[str]:
        of = self.tokens.__getitem__
        return [b"".join(map(of, ids.tolist())).decode("utf-8", "replace") for ids in batch]


@functools.lru_cache(2)
def loaded(spec: bytes) -> ByteBpe:
    """One encoder a task and tokenizer: workers are reused, and what runs in them next may need the memory."""
    return ByteBpe(spec)


def slices(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of texts of about so many characters together; a longer text is a run of its own."""
    start = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield slice(start, k)
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def read_spec(path: str) -> bytes:
    """The tokenizer file, read on the driver and shipped with the tasks (a vocabulary: a few MB at most)."""
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the tokenizer file is too large to ship")
    return spec


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>`` for every row; null texts count as empty. Rows repeat as they come."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for rows, texts in text_slices(batch):
                for part in slices(texts):
                    ids = bpe.encode_batch(texts[part])
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                    yield pa.RecordBatch.from_arrays([rows.column(0)[part.start : part.stop], pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run, lambda: loaded.cache_clear()), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``id, text`` from the ids of ``encode``; special tokens stay, bytes that are no UTF-8 become U+FFFD."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            texts = bpe.decode_batch([np.array(i.as_py() or [], np.int32) for i in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(released(run, lambda: loaded.cache_clear()), f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row, the text encoded and its ids decoded.

    Null texts count as empty. The ids are hashed as decimals joined by commas, the decoded text in UTF-8.
    Long texts are encoded whole. An empty table gives an empty result; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for rows, texts in text_slices(batch):
                for part in slices(texts):
                    ids = bpe.encode_batch(texts[part])
                    listed = [hashlib.sha256(b",".join(map(bpe.names.__getitem__, i.tolist()))).hexdigest() for i in ids]
                    back = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_batch(ids)]
                    columns = [rows.column(0)[part.start : part.stop], pa.array(list(map(len, ids)), pa.int64()), pa.array(listed), pa.array(back)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run, lambda: loaded.cache_clear()), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
