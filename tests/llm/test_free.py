"""The operators that run Python, against brute force, exact round trips and held-out accuracy."""

import gzip
import hashlib
import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from repolith.llm import bpe, files, jpeg_media, simhash, token_shards, toxicity, url_filter, warc
from repolith.llm.queries import RULES, tokenizer_path
from tests.llm.conftest import doc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# toxicity


def small_corpus(n, seed=3):
    rng = random.Random(seed)
    parts = ["ta", "ro", "mi", "ne", "lo", "su", "ka", "di"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        if k % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["worthless", "disgusting", "pathetic"]))
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_toxicity_held_out_and_misspellings():
    texts, labels = small_corpus(300)
    model = toxicity.fit(texts[:200], labels[:200])
    score = toxicity.Scorer(*toxicity.folded(model))
    p = score(texts[200:])
    assert ((p >= 0.5) == np.array(labels[200:])).mean() > 0.95
    odd = score(["ta ro mi " * 5 + w + " ne lo su" * 5 for w in ("worthles", "disgustingly", "patheticc")])
    assert (odd >= 0.5).all()
    assert score(["", None])[0] < 0.5
    # a long clean text does not hide one bad passage
    assert score(["taro mine losu " * 3000 + "worthless disgusting" + " taro mine" * 3000])[0] >= 0.5


def test_toxicity_tables(spark, make_docs):
    texts, labels = small_corpus(120)
    docs = make_docs([doc(k, t) for k, t in enumerate(texts)] + [doc(500, None), doc(501, ""), doc(None, "taro")])
    told = spark.createDataFrame([(k, x) for k, x in enumerate(labels)] + [(900, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(docs, told)
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 123
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, r in got.items() if not r.predicted)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_one_class():
    assert toxicity.fit([], []).shift < 0 and toxicity.fit(["a b"], [1]).shift > 0


# BPE


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.ByteBpe(bpe.read_spec(tokenizer_path())), Tokenizer.from_file(tokenizer_path())


ALPHABET = "aabbeett  \n\t\r\x1c\x85\xa0\u3000\u200b019'srveml.,!?-_éßñ中文🙂\u0301\x00\x7f²"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET) | st.characters(exclude_categories=["Cs"]), max_size=80) | st.sampled_from(["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 5000, " " * 300, "ab" * 3000, "\n" * 77 + "x"]))
def test_bpe_equals_library(pair, text):
    own, library = pair
    want = library.encode(text, add_special_tokens=False).ids
    (ids,) = own.encode_batch([text])
    assert ids.tolist() == want
    assert own.decode_batch([ids])[0] == library.decode(want, skip_special_tokens=False)


def test_bpe_pairs_agree_with_merging(pair):
    own, _ = pair
    rng = random.Random(1)
    a = np.array([rng.randrange(50_000) for _ in range(3000)])
    b = np.array([rng.randrange(50_000) for _ in range(3000)])
    a[:500] = b[:500] = np.array([own.byte_id[rng.choice(b"abcde tion")] for _ in range(500)])
    want = [own.merge_exactly(own.tokens[x] + own.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert own.compatible(a, b).tolist() == want
    assert own.merge_exactly(b"abcde" * 40) == own.encode_words([b"abcde" * 40])[0]


def test_bpe_tables(spark, make_docs, odd_docs, pair):
    own, library = pair
    docs = make_docs(odd_docs)
    texts = {r[0]: r[1] or "" for r in odd_docs}
    got = bpe.round_trip(docs, tokenizer_path()).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in odd_docs)
    for r in got:
        ids = library.encode(texts[r.id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()
    assert Counter((r.id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in odd_docs)
    assert bpe.round_trip(docs.limit(0), tokenizer_path()).count() == 0


# token shards


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=5))
def test_feistel_is_a_bijection(n, key):
    order = token_shards.FeistelPermutation(n, key)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.index(slots) == np.arange(n)).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(ALPHABET), max_size=40), max_size=5))
def test_token_ids_equal_library(pair, texts):
    _, library = pair
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        got = list(token_shards.token_ids(f.read(), token_shards.pa.array(texts, token_shards.pa.string())))
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_shards(spark, make_docs, odd_docs, tmp_path, pair):
    """Every record against the library's ids, and its slot against the permutation of its place in the input."""
    _, library = pair
    make_docs(odd_docs).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    vocabulary = tokenizer_path("byte_bpe_50k.tiktoken")
    manifest = token_shards.write_shards(docs, vocabulary, 50256, f"file://{tmp_path}/shards", length=16, per_shard=100)
    got = sorted(token_shards.read_back(manifest, per_shard=100).collect())
    # the order before the permutation is that of the table's partitions
    before = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(library.encode((r.text or "").replace("<|endoftext|>", "<| endoftext|>"), add_special_tokens=False).ids + [50256], "<u2")
        before += [(r.doc_id, part, len(own), zlib.crc32(own.tobytes())) for part, own in enumerate(ids[at : at + 16] for at in range(0, len(ids), 16))]
    order = token_shards.FeistelPermutation(len(before))
    slots = order.slot(np.arange(len(before)))
    want = sorted((int(s), int(s) // 100, *record) for s, record in zip(slots, before))
    assert [tuple(r) for r in got] == want
    assert (order.index(slots) == np.arange(len(before))).all()
    for m in manifest.collect():
        kind = 16 + 16 * 2
        with files.open_file(m.path) as f:
            assert len(f.read()) == m.sequences * kind
        # resuming in the middle reads what a whole read has there
        whole = np.concatenate([h for h, _ in token_shards.read_records(m.path, 16, 2)])
        rest = list(token_shards.read_records(m.path, 16, 2, start=3, count=5))
        if rest:
            assert (rest[0][0] == whole[3:8]).all()
    assert token_shards.read_back(token_shards.write_shards(docs.limit(0), vocabulary, 50256, f"file://{tmp_path}/none")).count() == 0


# JPEG


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700) | st.sampled_from([b"\xff" * 200, b"\x00" * 64, bytes(range(256))]), min_size=1, max_size=6))
def test_jpeg_round_trip(payloads):
    padded = [p + bytes(-len(p) % 64) for p in payloads]
    found = jpeg_media.decode(jpeg_media.store(padded))
    assert [jpeg_media.stored_payload(*f) for f in found] == padded


def reference_encode(grids, quants, restart, samplings):
    """A colour baseline JPEG with real Huffman codes, written bit by bit: the decoder's other half."""
    codes = {}
    out = bytes([0xFF, 0xD8])
    for k, q in enumerate(quants):
        out += jpeg_media.segment(jpeg_media.DQT, bytes([k]) + bytes(q))
    (h0, v0), blocks = samplings[0], grids
    mx, my = len(blocks[0][0]) // h0, len(blocks[0]) // v0
    frame = b"\x08" + (my * 8 * v0).to_bytes(2, "big") + (mx * 8 * h0).to_bytes(2, "big") + bytes([len(samplings)])
    for k, (h, v) in enumerate(samplings):
        frame += bytes([k + 1, h << 4 | v, min(k, 1)])
    out += jpeg_media.segment(jpeg_media.SOF0, frame)
    symbols = list(range(12)), [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    for t, own in enumerate(symbols):
        length = 4 if t == 0 else 8
        counts = [0] * 16
        counts[length - 1] = len(own)
        codes[t] = {s: (k, length) for k, s in enumerate(own)}
        out += jpeg_media.segment(jpeg_media.DHT, bytes([t << 4]) + bytes(counts) + bytes(own))
    if restart:
        out += jpeg_media.segment(jpeg_media.DRI, restart.to_bytes(2, "big"))
    out += jpeg_media.segment(jpeg_media.SOS, bytes([len(samplings)]) + b"".join(bytes([k + 1, 0]) for k in range(len(samplings))) + bytes([0, 63, 0]))
    bits, last, body = "", [0] * len(samplings), b""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    n = 0
    for y, x in itertools.product(range(my), range(mx)):
        if restart and n and n % restart == 0:
            body += flush(bits) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            bits, last = "", [0] * len(samplings)
        for k, (h, v) in enumerate(samplings):
            for dy, dx in itertools.product(range(v), range(h)):
                b = blocks[k][y * v + dy][x * h + dx]
                size, extra = value(b[0] - last[k])
                last[k] = b[0]
                code, length = codes[0][size]
                bits += format(code, f"0{length}b") + extra
                run = 0
                top = max([i for i in range(1, 64) if b[i]], default=0)
                for i in range(1, top + 1):
                    if not b[i]:
                        run += 1
                        continue
                    while run > 15:
                        code, length = codes[1][0xF0]
                        bits += format(code, f"0{length}b")
                        run -= 16
                    size, extra = value(b[i])
                    code, length = codes[1][run << 4 | size]
                    bits += format(code, f"0{length}b") + extra
                    run = 0
                if top < 63:
                    code, length = codes[1][0x00]
                    bits += format(code, f"0{length}b")
        n += 1
    return out + body + flush(bits) + bytes([0xFF, 0xD9])


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_jpeg_decodes_colour_with_runs(restart):
    rng = random.Random(restart)

    def block():
        b = [rng.randint(-300, 300)] + [0] * 63
        for _ in range(rng.randint(0, 12)):
            b[rng.randint(1, 63)] = rng.choice([-1, 1]) * rng.randint(1, 900)
        return b

    samplings = [(2, 2), (1, 1), (1, 1)]
    grids = [[[block() for _ in range(4 * h)] for _ in range(3 * v)] for h, v in samplings]
    jpeg = reference_encode(grids, [[2] * 64, [3] * 64], restart, samplings)
    ((picture, blocks),) = jpeg_media.decode([jpeg])
    want = [grids[k][y * v + dy][x * h + dx] for y, x in itertools.product(range(3), range(4)) for k, (h, v) in enumerate(samplings) for dy, dx in itertools.product(range(v), range(h))]
    assert blocks.tolist() == want
    thumb = jpeg_media.thumbnail(picture, blocks)
    assert thumb.tolist() == [[min(255, max(0, round(b[0] * 2 / 8 + 128))) for b in line] for line in grids[0]]


def test_jpeg_refuses_broken():
    good = jpeg_media.store([bytes(range(64)) * 3])[0]
    for bad in (b"", b"no", good[:40], good[:-4], good.replace(bytes([0xFF, 0xC0]), bytes([0xFF, 0xC2]))):
        with pytest.raises(ValueError):
            jpeg_media.decode([bad])


def test_jpeg_tables(spark, make_docs, odd_docs):
    got = jpeg_media.read_media(jpeg_media.add_media(make_docs(odd_docs))).collect()
    assert len(got) == len(odd_docs)
    texts = {r[0]: (r[1] or "").encode() for r in odd_docs}
    for r in got:
        t = texts[r.id]
        p = t + bytes(-len(t) % 64 or 64 * (not t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        (stored,) = jpeg_media.store([p])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert jpeg_media.read_media(jpeg_media.add_media(make_docs([]))).count() == 0


# WARC


def test_warc(spark, tmp_path):
    long_, short = "é" * 60, "x" * 99
    rows = [(1, "http://a/", long_), (2, "http://b/\r\nInjected: 1", long_), (3, None, short), (4, "http://d/", short), (5, "http://e/", None), (6, "u", ""), (7, "u", "y" * 100), (0, "u", "y" * 100), (0, "u", "y" * 100), (None, "u", "z" * 200), (None, "u", "z" * 200), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, record_type string").repartition(4)
    manifest = warc.write_archives(warc.resolve_revisits(pages), f"file://{tmp_path}")
    got = warc.read_archives(manifest, "bigint").collect()
    assert len(got) == len(rows)
    for r in got:
        html = {k: h for k, _, h in rows}[r.page_id] or ""
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {2: 1, 7: 0}
    assert Counter(r.record_type for r in got) == {"response": 10, "revisit": 2}
    for m in manifest.collect():
        with files.open_file(m.path) as stored, gzip.open(stored) as f:
            records = list(warc.read_records(f))
        assert len(records) == m.records and all("injected" not in h for h, _ in records)
    assert warc.deduplicate(pages.limit(0)).count() == 0


def test_warc_pages_that_repeat(spark):
    """Several responses of one page: a revisit has the digest of the one with its payload."""
    a, b, long = "a" * 200, "b" * 200, "long ü " * 200_000
    rows = [(1, b), (1, a), (2, a), (3, b), (1, "c"), (4, long), (5, long), (None, a), (1, a)]
    got = warc.deduplicate(spark.createDataFrame([(i, "http://x/", h) for i, h in rows], "page_id long, url string, html string").repartition(3)).collect()
    told = lambda i, h, kind, to: (i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), kind, to)
    want = [told(1, b, "response", None), told(1, a, "response", None), told(1, a, "response", None), told(2, a, "revisit", 1), told(None, a, "revisit", 1), told(3, b, "revisit", 1), told(1, "c", "response", None), told(4, long, "response", None), told(5, long, "revisit", 4)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_warc_identifiers_of_any_text(spark):
    ids = ["a\nb", "<z>", "", "%0A", "plain", "é ü", None, " spaced "]
    pages = spark.createDataFrame([(i, "http://x", f"page {k} " * 30) for k, i in enumerate(ids)] + [("twin", None, "page 4 " * 30)], "page_id string, url string, html string")
    got = warc.deduplicate(pages).collect()
    assert Counter(r.page_id for r in got) == Counter([*ids, "twin"])
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [("twin", "plain")]


# URLs


def test_url_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/"), "https://EXAMPLE.net/en/1?q": ("example.net", "/en/1", "example.net/en/"), "x://w.example.com/de/": ("w.example.com", "/de/", "example.com/de/"),
        "x://example.com/de": ("example.com", "/de", None), "x://b.org/fr/": ("b.org", "/fr/", "org/fr/"), "x://notexample.com/de/": ("notexample.com", "/de/", None), "x://a.net": ("a.net", "", None),
        None: ("", "", None), "no scheme": ("", "", None), "x://": ("", "", None), "x://h#f/net/": ("h", "", None), "x://y.net?z/": ("y.net", "", None), "x://ÄB.org/p/é": ("Äb.org", "/p/é", None), "a://b://c/d": ("b:", "//c/d", None),
    }
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(cases)], "page_id long, url string, host string, template string")
    got = url_filter.judge(pages, RULES).collect()
    for r in got:
        assert (r.host, r.path, r.rule) == list(cases.values())[r.page_id]
        if r.rule:
            assert r.verdict == next(x.action for x in RULES if x.text == r.rule)
    assert len(got) == len(cases) and url_filter.judge(pages.limit(0), RULES).count() == 0


def test_template_tree(spark):
    urls = [("h", f"/user/{k}/posts", 1) for k in range(30)] + [("h", f"/user/{k}/posts", None) for k in range(30, 40)]
    urls += [("h", f"/tag/word{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrstuvwxyz'[k // 26]}", None) for k in range(60)]
    urls += [("h", f"/{lang}/news/{k}", 0) for lang in ("aa", "bb") for k in range(20)]
    urls += [("k", "/", None), ("k", "", None), ("k", "/1/2/3/4/5/6/7/8/9", None)]
    df = spark.createDataFrame(urls, "host string, path string, label int").repartition(5)
    from pyspark.sql import functions as F

    grown = url_filter.grow_templates(df.select("host", url_filter.shape(F.col("path")).alias("parts"), "label")).collect()
    found = {(r.host, tuple(r.parts)): r for r in grown}
    bad = found["h", ("user", "{n}", "posts")]
    assert bad.template == "/user/{n}/posts" and bad.purity >= url_filter.PURITY
    assert {r.template for r in grown if r.host == "h" and r.parts[0] == "tag"} == {"/tag/*"}
    assert {r.template for r in grown if r.parts and r.parts[-1] == "{n}" and len(r.parts) == 3} == {"/(aa|bb)/news/{n}"}
    assert found["h", ("aa", "news", "{n}")].purity < 0.1
    assert found["k", ()].template == "" and found["k", ("{n}",) * 9].template == "/{n}" * 9
    prior = 30 / 70
    assert abs(bad.purity - (30 + 4 * prior) / 34) < 1e-9


def plain_tree(urls):
    """(host, parts, label) -> template and purity of each shape, level by level with plain dictionaries."""
    share, weight = 0.05, 4.0
    rows = {}
    for host, parts, label in urls:
        r = rows.setdefault((host, tuple(parts)), {"n": 0, "bad": 0, "good": 0, "t": ""})
        r["n"] += 1
        r["bad"] += label == 1
        r["good"] += label == 0
    bad, known = sum(r["bad"] for r in rows.values()), sum(r["bad"] + r["good"] for r in rows.values())
    prior = bad / known if known else 0.5
    for (h, p), r in rows.items():
        others = [x for (g, q), x in rows.items() if q == p and g != h]
        b, k = sum(x["bad"] for x in others), sum(x["bad"] + x["good"] for x in others)
        r["lean"] = (b + weight * prior) / (k + weight)
        r["likely"] = r["bad"] + (r["n"] - r["bad"] - r["good"]) * r["lean"]
    keeps = lambda counts, x: len(counts) <= 20 or counts[x] >= share * sum(counts.values())
    for d in range(max((len(p) for _, p in rows), default=0)):
        nodes = {}
        for (h, p), r in rows.items():
            if len(p) > d:
                nodes.setdefault((h, r["t"]), []).append((p, r))
        for own in nodes.values():
            counts = Counter()
            for p, r in own:
                counts[p[d]] += r["n"]
            branches = {}
            for p, r in own:
                branches.setdefault(p[d] if keeps(counts, p[d]) else "*", []).append((p, r))
            sets, kind = {}, {}
            for value, inside in branches.items():
                n = sum(r["n"] for _, r in inside)
                kind[value] = int(sum(r["likely"] for _, r in inside) / n * 2.999)
                below, size = Counter(), Counter()
                for p, r in inside:
                    child = p[d + 1] if len(p) > d + 1 else ""
                    below[child] += r["n"]
                    if child:
                        size[child] += r["n"]
                sets[value] = Counter()
                for child, m in below.items():
                    sets[value][child if not child or keeps(size, child) else "*"] += m / n
            least = {v: v for v in branches}
            for a, b in itertools.combinations(sorted(v for v in branches if v != "*"), 2):
                if kind[a] == kind[b] and 1 - sum(min(m, sets[b][c]) for c, m in sets[a].items()) <= 0.25 + 1e-9:
                    x, y = sorted((least[a], least[b]))
                    least = {v: x if at == y else at for v, at in least.items()}
            for value, inside in branches.items():
                group = sorted(v for v in branches if least[v] == least[value])
                name = value if len(group) == 1 else f"({'|'.join(group)})"
                for _, r in inside:
                    r["t"] += "/" + name
    found = {}
    for (h, p), r in rows.items():
        same = [x for (g, _), x in rows.items() if g == h and x["t"] == r["t"]]
        lean = sum(x["n"] * x["lean"] for x in same) / sum(x["n"] for x in same)
        found[h, p] = r["t"], (sum(x["bad"] for x in same) + weight * lean) / (sum(x["bad"] + x["good"] for x in same) + weight)
    return found


@pytest.mark.parametrize(("seed", "labels"), [(1, (0, 1, None, None)), (2, (None,)), (3, (1, None)), (4, (0, 1))])
def test_template_tree_equals_plain_one(spark, seed, labels):
    rng = random.Random(seed)
    urls = []
    for _ in range(700):
        host = rng.choice(["a.net", "b.net", "b.net", "c.org"])
        parts = [rng.choice(["de", "fr", "en"]), *(rng.choice([f"w{rng.randrange(40)}", "news", "tag", "{n}"]) for _ in range(rng.randrange(4)))][: rng.randrange(5)]
        urls.append((host, parts, rng.choice(labels) if host != "c.org" else None))
    grown = url_filter.grow_templates(spark.createDataFrame(urls, "host string, parts array<string>, label int").repartition(5)).collect()
    want = plain_tree(urls)
    assert len(grown) == len(want)
    for r in grown:
        template, purity = want[r.host, tuple(r.parts)]
        assert r.template == template and abs(r.purity - purity) < 1e-9


def test_hosts_without_labels_are_judged_by_others(spark):
    pages = [(k, f"http://h{k % 5}.net/de/{k}") for k in range(40)] + [(100 + k, f"http://site.info/{'de' if k % 2 else 'fr'}/{k}") for k in range(20)] + [(200 + k, f"http://x.org/fr/{k}") for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(df, RULES).collect()}
    assert {verdicts[100 + k] for k in range(1, 20, 2)} == {"block"} and {verdicts[100 + k] for k in range(0, 20, 2)} == {"allow"}
    # no rule that fits anything: no label at all
    assert {r.verdict for r in url_filter.judge(df, [url_filter.Rule("block", "nowhere/")]).collect()} == {"allow"}


# SimHash


def plain_print(text):
    words = (text or "").translate(UP).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, most):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= most:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(k) for k in range(len(prints))]


def near_prints(n, seed=0):
    rng = random.Random(seed)
    out = {0}
    while len(out) < n:
        x = rng.choice([*out][-40:]) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_index_finds_all_pairs():
    prints = np.array(near_prints(700, 5), np.uint64)
    got = {(int(i), int(j)) for a, b in simhash.GrayIndex(prints).within(2, block=100) for i, j in zip(a, b)}
    want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(int(prints[i]) ^ int(prints[j])).count("1") <= 2}
    assert got == want


@pytest.mark.parametrize("limit", [20_000, 5])
def test_links_and_components(spark, limit):
    prints = near_prints(500, 9)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(6)
    got = {r.node: r.root for r in simhash.components(simhash.find_links(df, 2, limit)).collect()}
    label = plain_components(prints, 2)
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, []).append(signed[k])
    want = {m: min(g) for g in groups.values() if len(g) > 1 for m in g}
    assert got == want


def test_gray_rank(spark):
    got = [r[0] for r in spark.range(64).select(simhash.gray_rank((simhash.F.col("id").bitwiseXOR(simhash.F.shiftrightunsigned("id", 1))))).collect()]
    assert got == list(range(64))


def test_near_duplicates(spark, make_docs, odd_docs):
    docs = make_docs(odd_docs)
    got = simhash.mark_near_duplicates(docs).collect()
    assert len(got) == len(odd_docs)
    prints = [plain_print(r[1]) for r in odd_docs]
    label = plain_components(prints, 2)
    want = Counter()
    for r, p, x in zip(odd_docs, prints, label):
        ids = [o[0] for o, y in zip(odd_docs, label) if y == x and o[0] is not None]
        want[r[0], p, min(ids) if ids else None] += 1
    assert Counter((r.id, r.fp % (1 << 64), r.component) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for _, _, c in want})  # the row without an identifier has a copy with one
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_files_are_per_attempt(tmp_path):
    made = []
    for _ in range(2):
        with files.new_file(f"file://{tmp_path}/deep/er", "a", ".bin") as (out, uri):
            out.write(os.urandom(3))
        made.append(uri)
    assert made[0] != made[1]
    for uri in made:
        with files.open_file(uri) as f:
            assert len(f.read()) == 3
