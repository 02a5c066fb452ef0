"""Operators against plain Python on small random tables with nulls and ties."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repolith.functions import classify, measures, paths, text
from repolith.operators import findings, graph, history, readings, replay, rollup
from repolith.plans.rules import FIELDS, Clause, Rule, parse


def fact_rows(n, seed):
    rng = random.Random(seed)
    return [(f"k{k}", f"d{k % 3}/f{k % 7}", f"n{k}", rng.choice(["func", "file"]), k, "p", *[None if rng.random() < 0.2 else float(rng.choice([0, 1, 2, 10, 20, 20, 50, 200])) for _ in FIELDS]) for k in range(n)]


@pytest.fixture(scope="module")
def facts(spark):
    rows = fact_rows(300, 4)
    schema = "key string, path string, name string, kind string, line long, pin string, " + ", ".join(f"{f} double" for f in FIELDS)
    return rows, spark.createDataFrame(rows, schema).repartition(5)


COLUMNS = ["key", "path", "name", "kind", "line", "pin", *FIELDS]
HOLDS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


def plain_hits(rule, rows):
    out = []
    for r in rows:
        d = dict(zip(COLUMNS, r))
        if d["kind"] == rule.pop and all(d[c.field] is not None and HOLDS[c.op](d[c.field], c.value) for c in rule.clauses):
            out.append(d)
    return out


def random_rules(n, seed):
    rng = random.Random(seed)
    return [Rule(rng.choice(["func", "file"]), tuple(Clause(rng.choice(list(FIELDS)), rng.choice(list(HOLDS)), float(rng.choice([0, 1, 10, 20, 50]))) for _ in range(rng.randint(1, 3))), id=f"r{k}") for k in range(n)]


def test_hits_only_ranks(facts):
    rows, df = facts
    rules = random_rules(40, 1)
    want = {r.id: plain_hits(r, rows) for r in rules}
    got = defaultdict(list)
    for r in findings.hits(df, rules).collect():
        got[r.rule].append(r.key)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(d["key"] for d in v) for k, v in want.items() if v}
    seen = Counter(d["key"] for v in want.values() for d in v)
    only = {r.rule: (r.hits, r["only"]) for r in findings.only_counts(findings.hits(df, rules)).collect()}
    assert only == {k: (len(v), sum(seen[d["key"]] == 1 for d in v)) for k, v in want.items() if v}
    top = findings.ranked(findings.hits(df, rules), 3).collect()
    for k, v in want.items():
        order = [d["key"] for d in sorted(v, key=lambda d: (-(d["loc"] if d["loc"] is not None else -1), d["key"]))][:3]
        assert [r.key for r in sorted((r for r in top if r.rule == k), key=lambda r: r["rank"])] == order
    assert findings.hits(df.limit(0), rules).count() == 0 and findings.hits(df, []).count() == 0


def test_spread_and_calibrate(facts):
    rows, df = facts
    for r in findings.spreads(df, ["loc", "trap", "age"]).collect():
        v = sorted(d[r.field] for d in (dict(zip(COLUMNS, x)) for x in rows) if d["kind"] == r.kind and d[r.field] is not None)
        assert (r.n, r.median, r.p95, r.max) == (len(v), v[int((len(v) - 1) * 0.5)], v[int((len(v) - 1) * 0.95)], v[-1])
    rules = random_rules(30, 2)
    got = {r.rule: r.value for r in findings.calibrate(df, rules, 5).collect()}
    for r in rules:
        c = r.clauses[0]
        v = sorted((d[c.field] for d in plain_hits(r.without_calibrated(), rows) if d[c.field] is not None), reverse=c.opens_up())
        assert got.get(r.id) == (v[4] if len(v) >= 5 and c.scope != "repo" else None)
    with pytest.raises(ValueError):
        findings.calibrate(df, rules, 0)


def plain_balance(rules, rows, target):
    """The greedy search, evaluating whole rules each time."""
    live = list(rules)
    keys = lambda r: {d["key"] for d in plain_hits(r, rows)}
    sets = [keys(r) for r in live]
    union = lambda s: len(set().union(*s))
    only = lambda s, i: sum(not any(k in x for j, x in enumerate(s) if j != i) for k in s[i])
    while union(sets) > target:
        best = None
        for i, r in enumerate(live):
            c = r.clauses[r.calibrated]
            v = sorted({d[c.field] for d in plain_hits(r, rows)})
            if c.scope == "repo" or c.graded or len(v) < 2:
                continue
            trial = r.at({">=": v[1], "<=": v[-2], ">": v[0], "<": v[-1]}[c.op])
            kept = keys(trial)
            if not kept or len(kept) == len(sets[i]):
                continue
            after = [*sets[:i], kept, *sets[i + 1 :]]
            score = (union(sets) - union(after), len(sets[i]) - only(sets, i))
            if best is None or score > best[0]:
                best = (score, i, trial, kept)
        if not best:
            break
        _, i, live[i], sets[i] = best
    return [(r.id, r.clauses[0].value, len(s)) for r, s in zip(live, sets)]


@pytest.mark.parametrize("target", [0, 10, 60])
def test_balance(facts, target):
    rows, df = facts
    rules = random_rules(12, 3)
    got = findings.balance(df, rules, target)
    assert [(r.id, r.old if r.new is None else r.new, r.hits_after) for r in got] == plain_balance(rules, rows, target)
    assert [r.clauses[0].value for r in findings.apply_balance(rules, got)] == [v for _, v, _ in plain_balance(rules, rows, target)]


def test_decisions(spark, facts):
    rows, df = facts
    rule = parse("func: loc >= 10 and calls >= 0")
    own = [d for d in plain_hits(rule, rows)]
    now = {r.key: r.p for r in df.where(findings.matches(rule)).select("key", findings.pin(rule).alias("p")).collect()}
    told = [(d["key"], "ad-hoc", v, p, k) for k, (d, (v, p)) in enumerate(zip(own, [("false-positive", now[own[0]["key"]]), ("fine-for-now", now[own[1]["key"]]), ("fine-for-now", "p loc=1 calls=1"), ("fine-always", "other"), ("flag", "x"), ("false-positive", "p loc=7 calls=8"), ("false-positive", "p ncloc=7")]))]
    told += [(own[3]["key"], "other-rule", "fine-always", "", 0)]
    live, settled = findings.live_hits(df, [rule], spark.createDataFrame(told, "key string, rule string, verdict string, pin string, seq int"))
    hidden = {own[k]["key"] for k in (0, 1, 3, 5)}
    assert {r.key for r in live.collect()} == {d["key"] for d in own} - hidden
    assert settled.collect()[0].settled == len(hidden)


def test_blocked(facts):
    _, df = facts
    bare = df.withColumn("callers", F.lit(None).cast("double"))
    rules = [Rule("func", parse(f"func: {t}").clauses, id=t) for t in ("loc >= 1", "callers >= 1", "age >= 1", "headcount >= 1", "surprise >= 0.5", "commits >= 1")]
    need = {r["rule"]: r["need"] for r in findings.blocked(bare, rules, findings.Traced(git=True, churned=False, blamed=False, read=False))}
    assert need == {"callers >= 1": findings.NEED_NONE, "headcount >= 1": findings.NEED_TRACE, "surprise >= 0.5": findings.NEED_READ, "commits >= 1": findings.NEED_TRACE}


def test_group_by_place():
    rows = [(f"a/b/f{k}.py", f"k{k}") for k in range(10)] + [("a/c/x.py", "x"), ("z.py", "z")]
    got = findings.group_by_place(rows)
    assert sorted(k for _, keys in got for k in keys) == sorted(k for _, k in rows)
    assert findings.group_by_place([]) == []
    assert paths.common_dir(["a/b/c.py", "a/b/d/e.py", "a/b/f.py"]) == "a/b" and paths.common_dir([]) == ""


def test_bands(spark):
    assert rollup.merge_bands({0: 40, 3: 10, 5: 25, 6: 1}) == {0: 0, 3: 0, 5: 0, 6: 0} or rollup.merge_bands({0: 40, 3: 10, 5: 25, 6: 1})[6] <= 5
    assert rollup.merge_bands({2: 5}) == {2: 2} and rollup.merge_bands({0: 50, 1: 29, 2: 31}) == {0: 0, 1: 0, 2: 2}
    rows = [(10, c) for c in range(40)] + [(20, 100)] * 3 + [(600, None)] * 50 + [(None, 4)]
    got = rollup.band_medians(spark.createDataFrame(rows, "ncloc long, cognitive long")).collect()
    assert [(r.band, r.size_from, r.size_to, r.members, r.median) for r in got] == [(0, 0, 24, 43, 21)]


def test_rollup_with_mixed_depth(spark):
    rows = [("a/x.py", 10, 0.9, 1.0, True), ("a/b/y.py", 30, 0.1, None, True), ("a/b/y.py", 0, 0.9, 0.5, False), ("z.py", 60, 0.2, 0.0, False)]
    df = spark.createDataFrame(rows, "path string, loc long, surprise double, tangle double, read boolean")
    df = df.select("path", "loc", F.col("loc").alias("ncloc"), F.lit(1).cast("long").alias("cognitive"), "surprise", F.lit(0.0).alias("documented"), F.lit(0.0).alias("churn"), F.lit(1.0).alias("age"), F.lit(2.0).alias("touched"), "read", "tangle", F.lit(None).cast("long").alias("callers"), F.lit(0).cast("long").alias("calls"))
    got = {r.path: r for r in rollup.tree_rollup(df).collect()}
    assert set(got) == {"a/x.py", "a/b/y.py", "z.py", "a/b", "a", ""}
    assert (got[""].loc, got[""].funcs, got["a"].loc, got["a"].callers) == (100, 4, 40, None)
    assert got["a"].hot_share == pytest.approx(10 / 40) and got["z.py"].hot_share is None
    assert got[""].surprise == pytest.approx((10 * 0.9 + 30 * 0.1 + 0.9 + 60 * 0.2) / 101)
    assert got["a/b"].tangle == pytest.approx(0.5) and got["a"].tangle == pytest.approx((10 * 1.0 + 30 * 0.5) / 40)


def test_graph(spark):
    nodes = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False), (4, "b", None), (5, "b", False), (6, "c", True)], "node long, dir string, is_test boolean")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (6, 1), (5, 5 - 1), (4, 5)], "src long, dst long")
    got = {r.node: r.under_test for r in graph.under_test(nodes, edges).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: None, 5: 1, 6: 0}
    d = {r.node: (r.callers, r.calls, r.dependents) for r in graph.degrees(nodes, edges).collect()}
    assert d[2] == (2, 1, 1) and d[4] == (2, 1, None) and d[6] == (0, 1, 0)
    loc = {r.node: (r.incident, r.away, r.gap) for r in graph.locality(nodes, edges).collect()}
    assert loc[2] == (2, 1, 0.5) and loc[3] == (2, 1, 0.5)


def test_call_tiers(spark):
    defs = spark.createDataFrame([("a", "f", None, "d/x", "d", True, False), ("b", "f", None, "d/y", "d", True, False), ("c", "f", "C", "e/z", "e", True, False), ("p", "g", None, "d/y", "d", False, False), ("t", "h", None, "d/x", "d", True, True), ("u", "u", None, "q/q", "q", True, False), ("v", "v", None, "q/q", "q", True, False), ("w", "v", None, "q/r", "q", True, False)], "key string, name string, owner string, path string, dir string, exported boolean, contract_test boolean").withColumn("family", F.lit("x"))
    calls = [("m", "1", "f", None, "d/x"), ("m", "2", "f", None, "d/zz"), ("m", "3", "f", "C", "d/x"), ("m", "4", "g", None, "d/x"), ("m", "5", "h", None, "d/x"), ("m", "6", "u", None, "d/x"), ("m", "7", "v", None, "d/x"), ("m", "8", "f", None, "zz/x"), ("n", "9", "u", None, "d/x"), ("a", "10", "f", None, "d/x")]
    df = spark.createDataFrame(calls, "caller string, call_id string, name string, qualifier string, path string").withColumns({"dir": paths.parent(F.col("path")), "family": F.lit("x"), "in_test": F.lit(False)})
    local = spark.createDataFrame([("n", "u")], "caller string, name string")
    got = defaultdict(set)
    for r in graph.resolve_calls(df, defs, local).collect():
        got[r.call_id].add(r.callee)
    assert got == {"1": {"a"}, "2": {"a", "b"}, "3": {"c"}, "6": {"u"}}


def test_blame_ties(spark):
    lines = spark.createDataFrame([("p", k, f"c{k % 3}", a, t) for k, (a, t) in enumerate([("x", 5), ("y", 9), ("x", 9), ("y", 1), ("", 2)], 1)], "path string, line_no long, commit string, author string, t long").withColumn("ts", F.timestamp_seconds("t"))
    f = spark.createDataFrame([("k", "p", 1, 4), ("none", "q", 1, 4)], "key string, path string, start_line long, end_line long")
    got = {r.key: r for r in history.blame_ranges(f, lines, F.timestamp_seconds(F.lit(86400 + 9))).collect()}
    assert (got["k"].last_author, got["k"].main_author, got["k"].headcount, got["k"].commits, got["k"].touched) == ("y", "y", 2, 3, 1.0)
    assert got["none"].headcount is None
    assert history.headcounts(lines).collect()[0].headcount == 2


def test_history_merge_equals_whole(spark):
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(5)}", f"c{k}", k, rng.randrange(50), f"a{rng.randrange(4)}") for k in range(200)]
    df = spark.createDataFrame(rows, "path string, sha string, seq long, t long, author string").withColumn("ts", F.timestamp_seconds(F.col("t") * 86400))
    now = F.timestamp_seconds(F.lit(60 * 86400))
    whole = sorted(map(tuple, history.path_history(df, now, 30).collect()))
    parts = history.merge_history(history.path_history(df.where("t < 25"), now, 30), history.path_history(df.where("t >= 25"), now, 30))
    assert sorted(map(tuple, parts.collect())) == whole


def test_replay_against_fold(spark):
    rng = random.Random(2)
    rows = [(k, f"f{rng.randrange(12)}", f"p{rng.randrange(3)}", rng.choice(["set", "set", "del"]), k % 17) for k in range(300)]
    df = spark.createDataFrame(rows, "idx long, func_id string, path string, op string, loc long").withColumn("ts", F.timestamp_seconds(F.col("idx") * 86400)).repartition(7)
    for at in (0, 77, 299):
        state, live, peak = {}, [], 0
        for i, f, p, op, loc in rows[: at + 1]:
            state.pop(f, None)
            if op == "set":
                state[f] = (p, loc)
        assert {r.func_id: (r.path, r.loc) for r in replay.as_of(df, at).collect()} == state
        base, later = replay.fold(df, 50)
        if at >= 50:
            assert {r.func_id: (r.path, r.loc) for r in replay.refold(base, later, at).collect()} == state
    alive, peak, seen = set(), 0, set()
    for _, f, _, op, _ in rows:
        seen.add(f)
        alive.add(f) if op == "set" else alive.discard(f)
        peak = max(peak, len(alive))
    r = replay.statistics(df).first()
    assert (r.ever, r.alive, r.peak) == (len(seen), len(alive), peak)


def test_queue_and_curve(spark):
    tasks = spark.createDataFrame([(k, f"p{k % 3 if k < 9 else 0}", float(k % 5)) for k in range(20)], "id long, path string, priority double")
    got = [r.id for r in sorted(readings.round_robin(tasks, 7).collect(), key=lambda r: r.place)]
    by = defaultdict(list)
    for r in sorted(tasks.collect(), key=lambda r: (-r.priority, r.id)):
        by[r.path].append(r.id)
    want, files = [], list(by.values())
    for k in range(20):
        want += [f[k] for f in files if len(f) > k]
    assert got == want[:7]


def test_window_ladder():
    assert measures.window_ladder(180) == [30, 60, 90, 180] and measures.window_ladder(29) == [4, 9, 14, 29] and measures.window_ladder(0) == [1, 1, 1, 1]


def test_text(spark):
    df = spark.createDataFrame([("parseFileName ofTheUser42x let HTTPServer", "fn go(a) { if a && b { x } }"), ("", "")], "a string, b string")
    r = df.select(text.words(F.col("a")).alias("w"), text.tokens(F.col("b")).alias("t"), text.shingles(F.col("b")).alias("s"), text.shape(F.col("b")).alias("sh")).collect()
    assert r[0].w == ["parse", "file", "name", "user42x", "httpserver"] and r[1].w == [] and r[1].s == []
    assert r[0].t[:4] == ["fn", "go", "(", "a"] and len(r[0].s) == len(set(zip(r[0].t, r[0].t[1:], r[0].t[2:]))) and r[0].sh is None
    j = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>").select(text.jaccard(F.col("x"), F.col("y")).alias("j")).collect()
    assert [x.j for x in j] == [pytest.approx(1 / 3), 0.0]
    same = spark.createDataFrame([("f(a1, 2) " * 10,), ("g(zz, 77) " * 10,), ("g[zz, 77) " * 10,)], "b string").select(text.shape(F.col("b")).alias("s")).collect()
    assert same[0].s == same[1].s != same[2].s


def test_classify(spark):
    cases = {"a/vendor/x.c": "vendored", "x.pb.go": "generated", "x.d.ts": "header", "src/x.h": "header", "src/x.c": None, "gen/x.c": "generated", "antlr/x.c": "generated"}
    df = spark.createDataFrame([(p, "") for p in cases] + [("q.c", "// DO NOT EDIT"), ("keep/q.c", None)], "path string, head string")
    got = {r.path: r.k for r in df.select("path", classify.code_kind(F.col("path"), F.col("head"), ("gen/*",))["kind"].alias("k")).collect()}
    assert got == {**cases, "q.c": "generated", "keep/q.c": None}
    t = spark.createDataFrame([("rust", "tests/a.rs", "f"), ("rust", "src/a.rs", "f"), ("go", "a_test.go", "f"), ("python", "conftest.py", "f"), ("shell", "a.sh", "test_x"), ("shell", "a.sh", "x"), ("c", "a.c", "f")], "lang string, path string, name string")
    got = [(r.t.is_test, r.t.how) if r.t else None for r in t.select(classify.testness(F.col("lang"), F.col("path"), F.col("name"), F.lit(False)).alias("t")).collect()]
    assert got == [(True, "contract"), (False, "contract"), (True, "contract"), (True, "convention"), (True, "convention"), None, None]


def test_search(spark):
    rows = [("func", "parse", "a/x.py", 3, 10), ("func", "parser", "a/x.py", 9, 99), ("file", "parse.py", "a/parse.py", 0, 5), ("dir", "b", "b/parse", 0, 1), ("func", "zz", "b/z.py", 1, 1)]
    df = spark.createDataFrame(rows, "kind string, name string, path string, line long, loc long")
    assert [r.name for r in readings.search(df, " Parse ", 9).collect()] == ["parse", "parse.py", "parser", "b"]
    assert readings.search(df, "p", 9).count() == 0


def test_collapse_chains(spark):
    dirs = spark.createDataFrame([("", 1, 1), ("a", 1, 1), ("a/b", 1, 1), ("a/b/c", 3, 1), ("a/b/c/d", 2, 0)], "path string, children long, dir_children long")
    assert {r.path: r.name for r in rollup.collapse_chains(dirs).collect()} == {"a/b/c": "a/b/c", "a/b/c/d": "d"}
