"""Names over time and ancestry against plain doubles."""

import random

import pytest
from pyspark.sql import functions as F

from repolith.operators import lineage

CHANGES = "idx long, op string, path string, source string"


def plain_lives(changes):
    """Replays commit by commit: retirements first, then arrivals."""
    alive, out = {}, []
    for idx in sorted({c[0] for c in changes}):
        mine = [c for c in changes if c[0] == idx]
        gone = {}
        for _, op, path, source in mine:
            name = path if op == "delete" else source if op == "rename" else None
            if name in alive:
                gone[name] = alive.pop(name)
                gone[name]["died"] = idx
        for _, op, path, source in mine:
            if op == "delete" or (path in alive and op in ("add", "modify")):
                continue
            if path in alive:
                alive[path]["died"] = idx
            life = {"path": path, "born": idx, "died": None, "origin": (path, idx), "renames": 0}
            if op == "rename" and source in gone:
                life |= {"origin": gone[source]["origin"], "renames": gone[source]["renames"] + 1}
            alive[path] = life
            out.append(life)
    return {(x["path"], x["born"]): (x["died"], *x["origin"], x["renames"]) for x in out}


def told(df):
    return {(r.path, r.born): (r.died, r.origin_path, r.origin_born, r.renames) for r in df.collect()}


def made_changes(seed, commits=60):
    draw, alive, fresh, out = random.Random(seed), set(), 0, []
    for idx in range(commits):
        busy = set()
        for _ in range(draw.randint(1, 3)):
            free = sorted(alive - busy)
            what = draw.choice(["add", "modify", "delete", "rename", "rename", "copy"])
            if what == "add" or not free:
                gone = [f"p{k}" for k in range(fresh) if f"p{k}" not in alive and f"p{k}" not in busy]
                path = draw.choice(gone) if gone and draw.random() < 0.4 else f"p{fresh}"
                fresh += path == f"p{fresh}"
                out.append((idx, "add", path, None))
                alive.add(path)
                busy.add(path)
                continue
            path = draw.choice(free)
            busy.add(path)
            if what in ("modify", "delete"):
                out.append((idx, what, path, None))
                alive -= {path} if what == "delete" else set()
                continue
            new = f"p{fresh}"
            fresh += 1
            busy.add(new)
            out.append((idx, what, new, path))
            alive |= {new}
            alive -= {path} if what == "rename" else set()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lives_equal_a_replay(spark, seed):
    changes = made_changes(seed)
    want = plain_lives(changes)
    df = spark.createDataFrame(changes, CHANGES).repartition(3)
    assert told(lineage.lives(df)) == want
    # two halves, and three parts, equal one
    for cuts in ([30], [10, 45]):
        state, low = None, -(1 << 30)
        for high in [*cuts, 1 << 30]:
            state = lineage.living(lineage.lives(df.where(F.col("idx").between(low, high - 1)), state))
            low = high
        assert told(state) == {k: v for k, v in want.items() if v[0] is None}


def test_a_long_chain_a_swap_and_a_copy(spark):
    chain = [(0, "add", "n0", None), *((k, "rename", f"n{k}", f"n{k - 1}") for k in range(1, 40))]
    swap = [(50, "add", "a", None), (50, "add", "b", None), (51, "rename", "a", "b"), (51, "rename", "b", "a"), (52, "copy", "c", "a"), (53, "delete", "a", None), (54, "add", "a", None), (55, "modify", "seen late", None), (56, "rename", "lost", "never seen")]
    got = told(lineage.lives(spark.createDataFrame(chain + swap, CHANGES)))
    assert got == plain_lives(chain + swap)
    assert got["n39", 39] == (None, "n0", 0, 39)
    assert got["a", 51] == (53, "b", 50, 1) and got["b", 51] == (None, "a", 50, 1)
    # the copy leaves its source alive and begins on its own
    assert got["c", 52] == (None, "c", 52, 0) and got["a", 54] == (None, "a", 54, 0) and got["lost", 56] == (None, "lost", 56, 0)


def test_histories_follow_renames(spark):
    changes = [(1, "add", "old", None), (2, "modify", "old", None), (3, "rename", "new", "old"), (4, "add", "old", None), (5, "modify", "new", None), (6, "delete", "x", None)]
    df = spark.createDataFrame(changes, CHANGES)
    got = lineage.history_of_living(df.select("path", "idx"), lineage.lives(df))
    assert {tuple(r) for r in got.collect()} == {("new", 4, 1, 5, 1), ("old", 1, 4, 4, 0)}


def test_no_changes(spark):
    assert lineage.lives(spark.createDataFrame([], CHANGES)).count() == 0


PARENTS = "sha string, nth int, parent string"


def made_parents(seed, n=150):
    draw, rows, up = random.Random(seed), [], {}
    for k in range(n):
        own = [] if k == 0 or draw.random() < 0.02 else sorted({draw.choice([k - 1, max(0, k - draw.randint(1, 12))]) for _ in range(draw.choice([1, 1, 1, 2, 3]))}, key=lambda x: (x * 7919 + seed) % 101)
        up[f"c{k}"] = [f"c{p}" for p in own]
        rows += [(f"c{k}", i, f"c{p}") for i, p in enumerate(own)] or [(f"c{k}", 0, None)]
    return rows, up


def reach(up, head):
    seen, left = set(), [head] if head in up else []
    while left:
        x = left.pop()
        if x not in seen:
            seen.add(x)
            left += up[x]
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_ancestry_equals_a_walk(spark, seed):
    rows, up = made_parents(seed)
    df = spark.createDataFrame(rows, PARENTS).repartition(3)
    heads = ["c149", "c148", "c100", "c37", "c1", "gone"]
    got = {r["head"]: (r.state, r.ahead) for r in lineage.carried(df, spark.createDataFrame([(h,) for h in heads], "head string"), "c149").collect()}
    mine = reach(up, "c149")
    for h in heads:
        older = h in mine
        assert got[h] == (("same", 0) if h == "c149" else ("grown", len(mine - reach(up, h))) if older else ("rewritten", len(mine))), h
    for h in ("c100", "c148"):
        assert {r.sha for r in lineage.ahead(df, h, "c149").collect()} == mine - reach(up, h)


def test_a_long_line_takes_few_rounds(spark):
    """A thousand commits in a line are ranked by doubling, and walked in no round at all."""
    rows = [("k0000", 0, None), *((f"k{k:04}", 0, f"k{k - 1:04}") for k in range(1, 1000))]
    df = spark.createDataFrame(rows, PARENTS)
    placed = lineage.chains(df)
    assert placed.agg(F.max("place"), F.countDistinct("chain")).first()[:] == (999, 1)
    got = lineage.carried(df, spark.createDataFrame([("k0990",)], "head string"), "k0999").first()
    assert (got["head"], got.state, got.ahead) == ("k0990", "grown", 9)
