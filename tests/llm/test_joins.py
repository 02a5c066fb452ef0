"""Spelling variants, exact top-k search and token alignment against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.llm import alignment, queries, spelling, topk
from tests.llm.conftest import doc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling ---------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = [n, len(others), form, words[form] if form else None]
    for w, found in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        found.append(root)
    return {w: tuple(x) for w, x in out.items()}


def variants(docs):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(docs).collect()}


def test_variants_equal_brute_force(make_docs, odd_docs):
    draw = random.Random(5)
    bases = ["gardening", "harvest", "Größenwahn", "àêïõüÿ", "letters", "lettersx", "mississippi"]
    text = []
    for base in bases:
        for w in [base, base[1:], base + "s", base[:3] + "q" + base[4:], base[:2] + base[3:], base[::-1], base[:4] + base[3:]]:
            text += [draw.choice([w, w.upper() if w.isascii() else w])] * draw.choice([1, 5, 7, 30, 200] if w != base else [40, 400])
    draw.shuffle(text)
    rows = odd_docs + [doc(1000 + k, " ".join(text[k::40])) for k in range(40)] + [doc(2000, "b×yte÷words " * 9), doc(2001, "chain_chainnn " * 6)]
    want = plain_variants([r[:2] for r in rows])
    assert variants(make_docs(rows)) == want
    assert sum(f is not None for _, _, f, _, _ in want.values()) > 8


def test_forms_are_followed_to_the_last(make_docs):
    """A chain of forms that is longer than one doubling."""
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [doc(k, " ".join([w] * (5 * 6**k))) for k, w in enumerate(words)]
    got = variants(make_docs(rows))
    assert {w: x[4] for w, x in got.items() if w in words} == dict.fromkeys(words, words[-1])
    assert got == plain_variants([r[:2] for r in rows])


def test_variants_of_nothing(make_docs):
    assert variants(make_docs([doc(1, None), doc(2, ""), doc(3, "short words only")])) == {}
    assert variants(make_docs([doc(1, "x")]).limit(0)) == {}


def test_a_hot_word_is_summed_in_its_task(make_docs):
    rows = [doc(k, "gardener " * 50 + f"own{'abcdefghij'[k % 10] * 4}") for k in range(400)]
    docs = make_docs(rows, 8)
    assert spelling.count_words(docs).where("word = 'gardener'").count() == 1
    # the plan sums before it shuffles, and the tasks hand over a row a word
    assert variants(docs) == plain_variants([r[:2] for r in rows])


# -- search -----------------------------------------------------------------------------------------------------------

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType()), T.StructField("size", T.StringType()), T.StructField("c", T.LongType())])


def plain_search(rows, each, k=5):
    sound = []
    for name, v, *_ in rows:
        if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            sound.append((name, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for name, v in sound:
        if name is None or name % each:
            continue
        all_ = [(-max(min(sum(a * b for a, b in zip(v, w, strict=True)), topk.MAX_LONG), topk.MIN_LONG), other is None, other or 0) for other, w in sound if other != name and len(w) == len(v)]
        out += [(name, r + 1, None if none else other, -s) for r, (s, none, other) in enumerate(sorted(all_)[:k])]
    return sorted(out, key=str)


def found(spark, rows, each, parts=3, **how):
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTOR).repartition(parts)
    got = topk.search(table, F.col("vec_id") % each == 0, **how).select("query_id", "rank", "vec_id", "score").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("size", [1, 3, 17, 64])
def test_search_equals_brute_force(spark, size):
    draw = np.random.default_rng(size)
    centres = draw.normal(size=(4, size))
    rows = [(k, (centres[k % 4] + draw.normal(size=size) * 0.3).tolist()) for k in range(400)]
    # copies of one vector over a third of the rows: ties that the identifier decides
    rows += [(1000 + k, rows[7][1]) for k in range(200)]
    # many rounds and cells of few rows
    got = found(spark, rows, 20, block_rows=40, query_rows=8)
    assert got == plain_search(rows, 20) and len(got) == 30 * 5


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, [0.5, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [0.1, 0.2, 0.3]), (7, [0.5, -0.25]), (8, [-0.0, 0.0]), (None, [0.5, 0.25]), (None, [0.9, 0.9]), (0, [0.5, 0.25]), (9, [0.3, 0.3]), (10, []), (12, [1.0, 2.0, 3.0])]
    assert found(spark, rows, 2) == plain_search(rows, 2)
    assert found(spark, rows[1:5], 1) == [] and found(spark, [], 1) == []
    big = [(k, [3e38 * (-1) ** k, 1e30, float(k)]) for k in range(12)] + [(20 + k, [2.0**31 + k * 4096, -(2.0**30), 5.0]) for k in range(12)]
    assert [r[:2] for r in found(spark, big, 4)] == [r[:2] for r in plain_search(big, 4)]
    assert found(spark, big[12:], 4) == plain_search(big[12:], 4)


def test_bounds_hold_at_every_resolution():
    draw = np.random.default_rng(1)
    for size in (2, 5, 16, 63, 64, 200):
        q, c = draw.integers(-300, 300, (2, 50, size))
        exact = q @ c.T
        bounds = [topk.statistics(q, s) @ topk.statistics(c, s).T for s in topk.resolutions(size)]
        for bound in bounds:
            assert (bound + 1e-6 >= exact).all()
        # finer is tighter where segments nest, and two components a segment are nearly exact
        assert bounds[-1].mean() <= bounds[0].mean() + 1e-6


def test_search_drops_candidates_before_exact_scores(monkeypatch):
    draw = np.random.default_rng(3)
    c = np.repeat(draw.normal(0, 200, (400, 8)), 8, axis=1).astype(np.int64) + draw.integers(-3, 4, (400, 64))
    q, ids = c[:1], np.arange(400)
    scores = np.sort(c @ q[0])[::-1]
    seen = []
    monkeypatch.setattr(topk, "exact_scores", lambda v, x, safe, f=topk.exact_scores: seen.append(len(v)) or f(v, x, safe))
    ((_, at, got),) = topk.search_block(q, np.array([-1]), np.array([scores[4]]), c, ids, np.zeros(400, bool), 5)
    assert got.tolist() == scores[:5].tolist() and seen[0] < 40


# -- alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    vocab = {i: bytes(byte_of[c] for c in s) for s, i in json.load(open(path_a))["model"]["vocab"].items()}
    return path_a, path_b, a, b, vocab


def plain_alignment(texts, tokenizers):
    _, _, a, b, vocab = tokenizers
    links, out = [], []
    for text in texts:
        plain = (" " + (text or "")).encode()
        ids_a = a.encode(plain.decode(), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [vocab[i] for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != plain or b"".join(raw_b) != plain:
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for raw in (raw_a, raw_b):
            ends = np.cumsum(list(map(len, raw))).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        own, j = [], 0
        for i, (x, y) in enumerate(spans[0]):
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                own.append((ids_a[i], ids_b[k]))
                k += 1
        ends = sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})
        groups, i, k = [], 0, 0
        for e in ends:
            sides = []
            for span, ids, at in ((spans[0], ids_a, i), (spans[1], ids_b, k)):
                until = at
                while until < len(span) and span[until][1] <= e:
                    until += 1
                sides.append(",".join(map(str, ids[at:until])))
                i, k = (until, k) if span is spans[0] else (i, until)
            groups.append("|".join(sides))
        links.append(own)
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(na, nb, ng, len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), digest) for (na, nb, ng, digest), own in zip(out, links, strict=True)]


def aligned(docs, tokenizers, **how):
    got = alignment.align(docs, *tokenizers[:2], **how).collect()
    return Counter((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


@pytest.mark.parametrize("chunk_chars", [1, 2000, 6_000_000])
def test_alignment_equals_the_libraries_on_whole_texts(make_docs, odd_docs, tokenizers, chunk_chars, monkeypatch):
    texts = [
        "The quick brown fox.", " leading", "trailing ", "two  spaces   and\n\nlines\t\ttabs ", "a\n b \n c", "mark ▁ inside", "x▁y", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul\0byte and\0",
        "ﬁ é é \U0001f600\U0001f1e9\U0001f1ea 漢字かな ไทย", "\u00a0nbsp\u2003em  sep", "it's we'll THEY'RE don't", "x" * 5000, "1234567890 " * 50 + "1", "\r\n", " ", "▁", "a\u180e b \u180ec \u200bd \ufeffe", "ab " * 30 + "ab",
    ]
    draw = random.Random(2)
    texts += ["".join(draw.choice(["a", "the", " ", "  ", "\n", "é", "\u2582", "strawberry", "'s", "9", "-", "\t", "漢", "ß"]) for _ in range(60)) for _ in range(60)]
    rows = odd_docs + [doc(1000 + k, t) for k, t in enumerate(texts)] + [doc(1003, texts[3])]
    monkeypatch.setattr(alignment, "SLAB_CHARS", 100)
    want = Counter((r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows], tokenizers), strict=True))
    assert aligned(make_docs(rows, 4), tokenizers, chunk_chars=chunk_chars) == want


def test_alignment_of_nothing(make_docs, tokenizers):
    assert aligned(make_docs([doc(1, "x")]).limit(0), tokenizers) == Counter()
    assert aligned(make_docs([doc(1, None), doc(None, "")]), tokenizers) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


def test_components_equal_a_plain_union_find():
    draw = random.Random(4)
    for nodes in (1, 2, 30, 200):
        u, v = (np.array([draw.randrange(nodes) for _ in range(nodes * 2 // 3)], np.int64) for _ in range(2))
        parent = list(range(nodes))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            low, high = sorted((root(x), root(y)))
            parent[high] = low
        assert alignment.find_components(u, v, nodes).tolist() == [root(x) for x in range(nodes)]


# -- the queries themselves -------------------------------------------------------------------------------------------


def test_queries_over_their_tables(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = queries.op11_symmetric_delete(spark, sf)
    assert dict(words.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in words.collect()} == plain_variants(docs)
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    best = queries.op12_segment_topk(spark, sf)
    assert best.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, best.collect()), key=str) == plain_search(vectors, 50)
    groups = queries.op13_token_alignment(spark, sf)
    assert groups.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    assert Counter(map(tuple, groups.collect())) == Counter((i, *x) for (i, _), x in zip(docs, plain_alignment([t for _, t in docs], tokenizers), strict=True))
