"""The near-dedup stage of the pipeline against brute force over exact Jaccard similarities."""

import itertools
import random

import pytest
from conftest import doc

import corpus_pipeline
from repolith.llm import near_dedup, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_components(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(k) for k in range(len(rows))]


def edited_texts(seed=3):
    """Texts of 60 to 200 words, copies of copies with a few words replaced or cut off, lines that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(30)]
    texts = []
    for _ in range(40):
        words = [word() for _ in range(rng.randint(60, 200))] + line * rng.randint(0, 1)
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = words[: len(words) - rng.choice([0, 0, 5, 20])]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
    return texts


@pytest.mark.parametrize("repeated", [4, 1 << 30])
def test_near_pairs_are_all_found(spark, make_docs, odd_docs, monkeypatch, repeated):
    monkeypatch.setattr(near_dedup, "REPEATED", repeated)
    rows = odd_docs + [doc(1000 + k, t) for k, t in enumerate(edited_texts())]
    docs = make_docs(rows)
    label = plain_components(rows)
    want = []
    for r, x in zip(rows, label):
        ids = [o[0] for o, y in zip(rows, label) if y == x and o[0] is not None]
        want.append((r[0], min(ids) if ids else None))
    order = lambda pairs: sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1] or 0))
    assert order((r.id, r.component) for r in near_dedup.mark_near_duplicates(docs).collect()) == order(want)


def test_stage_drops_what_fingerprints_miss(spark, make_docs):
    words = [f"w{k}" for k in range(100)]
    changed = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 86 of 106 shingles: 0.81
    far = [*words[:25], "x", *words[26:50], "y", *words[51:75], "z", *words[76:]]  # 81 of 111: 0.73
    docs = make_docs([doc(k, " ".join(w)) for k, w in enumerate((words, changed, far))])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_stage_takes_what_the_gray_index_links(spark, make_docs):
    """Fingerprints count repeats and sets do not: one and the same line over and over decides the fingerprint."""
    line = "one line of words that comes again and again " * 40
    rows = [doc(k, f"{line} {' '.join(f'own{k}x{i}' for i in range(12))}") for k in range(6)] + [doc(9, " ".join(f"w{k}" for k in range(50)))]
    docs = make_docs(rows)
    marked = {r.id: r.component for r in simhash.mark_near_duplicates(docs).collect()}
    assert len(set(marked.values())) < 7 == near_dedup.mark_near_duplicates(docs).select("component").distinct().count()
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(marked.values())
