"""Sharding, exact duplicates and mixing against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repolith.llm import exact_dedup, mixing, sharding
from tests.llm.conftest import doc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(UP)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, make_docs, odd_docs, keep):
    got = exact_dedup.mark_duplicates(make_docs(odd_docs), keep=keep).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(odd_docs)
    groups = defaultdict(list)
    for r in odd_docs:
        groups[norm(r[1])].append(r[0])
    for r in got:
        own = groups[norm(r.text)]
        known = [i for i in own if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(own))
    kept = Counter(norm(r.text) for r in got if r.kept)
    assert kept == Counter(groups.keys())


def test_exact_hot_group_is_split_and_whole(spark, make_docs):
    rows = [doc(k, "Hot Text" if k % 2 else f"own {k}") for k in range(600)]
    got = exact_dedup.mark_duplicates(make_docs(rows, 7)).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    hot = [r for r in got if r.doc_id % 2]
    assert {(r.keep_id, r.group_size) for r in hot} == {(599, 300)} and [r.doc_id for r in hot if r.kept] == [599]
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 2 == 0)


def test_exact_drop_keeps_columns(spark, make_docs, odd_docs):
    docs = make_docs(odd_docs)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert out.count() == len({norm(r[1]) for r in odd_docs})
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_exact_native_plan(spark, make_docs, odd_docs):
    plan = exact_dedup.mark_duplicates(make_docs(odd_docs))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() and "Python" not in plan and "Arrow" not in plan


def hilbert_point(index, bits, n):
    """The inverse of the curve, by the classic bit procedure."""
    x = [0] * n
    for b in range(bits * n):
        bit = (index >> (bits * n - 1 - b)) & 1
        x[b % n] = x[b % n] << 1 | bit
    t = x[n - 1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q != 1 << bits:
        p = q - 1
        for i in range(n - 1, -1, -1):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q <<= 1
    return x


@pytest.mark.parametrize("bits,n", [(1, 2), (2, 2), (3, 3), (4, 2)])
def test_hilbert_curve(spark, bits, n):
    side = 1 << bits
    df = spark.range(side**n).select(*[(F.floor(F.col("id") / side**k) % side).alias(f"a{k}") for k in range(n)])
    got = {tuple(r[:n]): r[n] for r in df.select(*df.columns, sharding.hilbert_index([F.col(c) for c in df.columns], bits)).collect()}
    assert sorted(got.values()) == list(range(side**n))
    by_place = [p for p, _ in sorted(got.items(), key=lambda kv: kv[1])]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(by_place, by_place[1:]))
    assert all(list(p) == hilbert_point(h, bits, n) for p, h in got.items())


@pytest.mark.parametrize("shards", [1, 7, 24, 500])
def test_shards_even_and_gapless(spark, make_docs, odd_docs, shards):
    docs = make_docs(odd_docs)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    placed = sharding.assign_shards(docs, [docs["source"], docs["lang"], size], shards, docs["doc_id"], F.crc32("text"), slices=5).select("row.doc_id", "shard", "slot", "curve").collect()
    assert len(placed) == len(odd_docs)
    counts = Counter(r.shard for r in placed)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for k in counts:
        assert sorted(r.slot for r in placed if r.shard == k) == list(range(counts[k]))
    order = [r.curve for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_empty(spark, make_docs):
    docs = make_docs([])
    assert sharding.assign_shards(docs, [docs["source"], docs["n_chars"]], 4, docs["doc_id"], F.lit(0)).count() == 0


def water_level(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by rounds: what is above a cap is shared again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 200, "c": 3000, None: 40}, {"a": 0, "b": 5}, {"z": 1, "é": 100, "Z": 1000, "b": 1, "c": 1}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = water_level(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mix(spark, make_docs, odd_docs):
    docs = make_docs(odd_docs)
    got = mixing.mark_mix(docs).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(odd_docs)
    words = lambda t: len((t or "").encode().split())
    totals = Counter()
    for r in got:
        assert r.size == words(r.text) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        totals[r.source] += r.taken
    sizes = Counter()
    for r in odd_docs:
        sizes[r[3]] += words(r[1])
    want = water_level(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
    largest = {s: max(words(r[1]) for r in odd_docs if r[3] == s) for s in sizes}
    for s in sizes:
        assert abs(totals[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mark_mix(make_docs(odd_docs, 5)).select("row.doc_id", "copies").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.copies) for r in got)


def test_mix_rows(spark, make_docs, odd_docs):
    docs = make_docs(odd_docs)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mark_mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mark_mix(make_docs([doc(1, None), doc(2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_crc_is_unsigned(spark, make_docs, odd_docs):
    for r in make_docs(odd_docs).select("text", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect():
        assert r.c == zlib.crc32((r.text or "").encode())


def test_shards_of_texts_with_long_common_starts(spark):
    """Whole texts order: neither a dimension nor identifiers that begin alike fall into one level."""
    df = spark.createDataFrame([(f"document-{k:05d}", f"https://common.example/{k % 8}", k) for k in range(800)], "doc_id string, source string, n long")
    placed = sharding.assign_shards(df, [df["source"]], 8, df["doc_id"], F.lit(0), slices=16).select("row.*", "shard", "slot", "curve").collect()
    by_source = defaultdict(set)
    for r in placed:
        by_source[r.source].add(r.curve)
    assert len({c for cs in by_source.values() for c in cs}) == 8 and all(len(cs) == 1 for cs in by_source.values())
    assert all(len({r.source for r in placed if r.shard == k}) == 1 for k in range(8))
    with pytest.raises(ValueError):
        sharding.assign_shards(df, [df["source"]] * 6, 8, df["doc_id"], F.lit(0))


def test_exact_frequent_texts_from_a_sample(spark, make_docs, monkeypatch):
    """Texts and heads that a sample finds often: salts and slices give the groups of a plain count."""
    monkeypatch.setattr(exact_dedup, "SEEN", 8)
    head = "the same twenty-four characters and more "
    texts = ["Hot one", "hot two " * 9, head.upper() + "hot"]
    rows = [doc(k, texts[k % 3] if k % 2 else head + str(k % 70)) for k in range(1200)]
    got = exact_dedup.mark_duplicates(make_docs(rows, 7)).select("row.doc_id", "row.text", "keep_id", "group_size", "kept").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    assert len(got) == 1200 and all((r.keep_id, r.group_size) == (max(groups[norm(r.text)]), len(groups[norm(r.text)])) for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(max(g) for g in groups.values())


def test_mix_meets_targets_where_identifiers_repeat(spark, make_docs):
    rows = [doc(None, " ".join(["w"] * 9 + [f"n{k}"]), "a") for k in range(40)] + [doc(2, " ".join(["w"] * 9 + [f"m{k}"]), "b") for k in range(300)]
    got = mixing.mark_mix(make_docs(rows)).groupBy("row.source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 10 for r in got)


@pytest.mark.parametrize("hot", [5, 900])
def test_mix_meets_targets_where_rows_repeat(spark, make_docs, hot):
    """Rows that repeat identifier, source and text are a group of which part is taken; other columns may differ."""
    rows = [doc(7, "x y z q", "b")] * hot + [doc(None, "p q r", "c")] * 60 + [doc(500 + k, "w " * (k % 30 + 1), "a") for k in range(100)] + [doc(3, None, "d")] * 4
    got = mixing.mark_mix(make_docs(rows, 5)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows)
    again = mixing.mark_mix(make_docs(rows, 2)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) and all(r.taken <= 3 * r.size for r in own)
        # of equal rows none is taken twice more often than another
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_numbering_a_group_in_parts(spark):
    rows = spark.createDataFrame([("s", 0.5, None, 1, 3, 41, f"r{k}") for k in range(200)] + [(None, 0.5, 1, 1, 3, 0, "none")], "source string, rank double, id long, tie long, size long, some long, mark string").repartition(7)
    got = mixing.first_of_groups(rows).select("source", "mark", "once").collect()
    assert len(got) == 201 and sum(r.once for r in got) == 41 and [r.once for r in got if r.source is None] == [0]
