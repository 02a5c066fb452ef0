"""Readings applied by difference, summaries, and frames with news, against plain doubles."""

import random

import pytest
from pyspark.sql import functions as F

from repolith.operators import reread

FUNCS = "key string, path string, loc long, surprise double, documented double, read int, age double, touched double, source string"


def made(seed, n=60):
    draw = random.Random(seed)
    return [(f"k{k}", f"{draw.choice('ab')}/{draw.choice('xyz')}/f{draw.randrange(6)}.py" if draw.random() < 0.9 else "top.py", draw.randrange(40), draw.choice([None, 0.1, 0.6, 0.9]), draw.choice([None, 0.4]), draw.choice([None, 0, 1]), draw.choice([None, *range(9)]), draw.choice([None, *range(9)]), "proxy") for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) and i in (6, 7) else x for i, x in enumerate(r)) for r in rows], FUNCS).repartition(3)


def told(df):
    return {r.path: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_a_difference_equals_the_whole(spark, seed):
    rows, draw = made(seed), random.Random(seed + 100)
    by_key = {r[0]: r for r in rows}
    changed = draw.sample(sorted(by_key), 12)
    after = dict(by_key)
    for k in changed[:8]:
        # sizes, grades and extremes move up, down and away; some functions move to another file
        r = after[k]
        after[k] = (r[0], draw.choice([r[1], "a/x/new.py"]), draw.randrange(40), draw.choice([None, 0.05, 0.95]), r[4], 1, draw.choice([None, 0, 20]), draw.choice([None, 0, 20]), "agent")
    for k in changed[8:]:
        del after[k]
    new = {f"new{k}": (f"new{k}", draw.choice(["b/y/f1.py", "c/only.py"]), 5, 0.7, None, 1, 3, 3, "agent") for k in range(3)}
    after |= new
    before = frame(spark, rows)
    now = frame(spark, after.values())
    old_part, new_part = frame(spark, [by_key[k] for k in changed]), frame(spark, [after[k] for k in [*changed, *new] if k in after])
    got = reread.rollup_delta(reread.rollup_state(before), old_part, new_part, now)
    whole = reread.rollup_state(now)
    assert told(got.select(whole.columns)) == told(whole)
    assert set(reread.figures(whole).columns) >= {"surprise", "hot_share", "analysed_share"}


def test_only_folders_above_a_change_move(spark):
    rows = made(9)
    before = frame(spark, rows)
    r = rows[0]
    change = frame(spark, [(*r[:2], r[2] + 3, *r[3:])])
    state = reread.rollup_state(before)
    got, was = told(reread.rollup_delta(state, frame(spark, [r]), change, before)), told(state)
    up = {"", *("/".join(r[1].split("/")[: k + 1]) for k in range(r[1].count("/") + 1))}
    assert {p for p in was if was[p] != got[p]} == up


def test_readings_apply_where_they_are_fresh(spark):
    f = frame(spark, [("a", "p", 1, 0.1, None, 0, 1, 1, "proxy"), ("b", "p", 1, 0.1, 0.2, None, 1, 1, "proxy"), ("c", "p", 1, None, 0.2, 1, 1, 1, "proxy")])
    r = spark.createDataFrame([("a", 0.9, None, False), ("b", 0.9, 0.9, True), ("gone", 0.9, 0.9, False), ("c", None, 0.7, None)], "key string, surprise double, documented double, stale boolean")
    got = {x.key: (x.surprise, x.documented, x.read, x.source) for x in reread.apply_readings(f, r).collect()}
    assert got == {"a": (0.9, None, 1, "agent"), "b": (0.1, 0.2, None, "proxy"), "c": (None, 0.7, 1, "agent")}
    assert reread.apply_readings(f, r.limit(0)).columns == [c for c in f.columns if c != "source"] + ["source"]


def test_summary_and_hottest(spark):
    schema = "key string, excluded boolean, predicted string, surprised boolean, legible string, trap boolean, stale boolean, has_reading boolean"
    rows = [("a", None, "most", None, "full", True, False, True), ("b", False, None, True, None, None, None, True), ("c", False, None, False, "some", True, True, True), ("d", True, "full", None, "full", True, False, True), ("e", False, None, None, None, None, None, False), ("f", False, None, None, None, None, None, True)]
    got = reread.summary(spark.createDataFrame(rows, schema)).first().asDict()
    assert got == {"functions": 5, "excluded": 1, "read": 3, "stale": 1, "unread": 1, "traps": 1, "predicted_full": 1, "predicted_most": 1, "predicted_some": 0, "predicted_none": 1, "legible_full": 1, "legible_most": 0, "legible_some": 0, "legible_none": 0}
    assert reread.summary(spark.createDataFrame([], schema)).first().functions == 0
    hot = spark.createDataFrame([("a", 0.9, 5, 1, False), ("b", 0.9, 9, 1, None), ("c", 0.95, 1, 0, False), ("d", 0.95, 1, 1, True), ("e", 0.5, 1, 1, False), ("f", 0.8, 1, 1, False)], "key string, surprise double, loc long, read int, excluded boolean")
    assert [(r.place, r.key) for r in reread.hottest(hot, 2).orderBy("place").collect()] == [(1, "b"), (2, "a")]


def test_a_frame_says_what_is_new(spark):
    d = [("f", 1, "set", "a/x", 5), ("g", 2, "set", "a/x", 6), ("h", 3, "set", "b/y", 7), ("g", 6, "set", "a/x", 8), ("k", 7, "set", "c/z/w", 1), ("h", 7, "del", "b/y", 0), ("m", 8, "set", "b/q", 2), ("n", 2, "set", "d/u", 4), ("n", 9, "set", "d/v", 4), ("late", 12, "set", "a/x", 9)]
    df = spark.createDataFrame(d, "func_id string, idx long, op string, path string, loc long")
    got = {r.path: (r.kind, r.functions, r.lines, r.appeared, r.edited) for r in reread.frame_tree(df, 10, 5).collect()}
    assert got == {
        "": ("dir", 5, 20, False, True), "a": ("dir", 2, 13, False, True), "a/x": ("file", 2, 13, False, True), "b": ("dir", 1, 2, False, True), "b/q": ("file", 1, 2, True, False),
        "c": ("dir", 1, 1, True, False), "c/z": ("dir", 1, 1, True, False), "c/z/w": ("file", 1, 1, True, False), "d": ("dir", 1, 4, False, True), "d/v": ("file", 1, 4, True, False),
    }
    quiet = reread.frame_tree(df, 10, 10).collect()
    assert len(quiet) == 10 and not any(r.appeared or r.edited for r in quiet)
    assert reread.frame_tree(df.where(F.lit(False)), 10, 5).count() == 0
