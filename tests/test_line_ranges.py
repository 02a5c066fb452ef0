"""Ranges of lines carried through diffs, against lines that are followed one by one."""

import difflib
import random

import numpy as np
import pyarrow as pa

from repolith.operators import line_ranges
from repolith.sources import git


def edited(draw, lines, fresh):
    out, k = [], 0
    while k < len(lines):
        p = draw.random()
        if p < 0.08:
            k += draw.randint(1, 4)
            continue
        if p < 0.16:
            out += [next(fresh) for _ in range(draw.randint(1, 4))]
        elif p < 0.24:
            k += draw.randint(1, 3)
            out += [next(fresh) for _ in range(draw.randint(1, 3))]
            continue
        out.append(lines[k])
        k += 1
    return out


def hunks_of(old, new):
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag != "equal":
            out.append((a + (b > a), b - a, c + (d > c), d - c))
    return out


def plain(versions, start, end):
    """The range from the newest version back; hunk by hunk, line by line."""
    out = []
    for idx in range(len(versions) - 1, 0, -1):
        old, new = versions[idx - 1], versions[idx]
        where = {line: k + 1 for k, line in enumerate(old)}
        mine = set(range(start, end + 1))
        added, removed, met, kept = 0, 0, False, []
        for a, n, c, m in hunks_of(old, new):
            inside = mine & set(range(c, c + m))
            within = m == 0 and start <= c < end
            if inside or within:
                met, added, removed = True, added + len(inside), removed + n
                kept += range(a, a + n)
        kept += [where[new[k - 1]] for k in mine if new[k - 1] in where]
        if met:
            out.append((idx, start, end, added, removed, not kept))
        if not kept:
            break
        start, end = min(kept), max(kept)
    return out


def ran(spark, files, asked):
    hunks = [(f, idx, *h) for f, versions in files.items() for idx in range(1, len(versions)) for h in hunks_of(versions[idx - 1], versions[idx])]
    h = spark.createDataFrame(hunks, "file string, idx long, old_start long, old_lines long, new_start long, new_lines long").repartition(3)
    a = spark.createDataFrame(asked, "file string, ask string, start long, end long")
    got = {}
    for r in line_ranges.range_history(a, h).collect():
        got.setdefault((r.file, r.ask), []).append((r.idx, r.start, r.end, r.added, r.removed, r.began))
    return {k: sorted(v, reverse=True) for k, v in got.items()}


def test_ranges_equal_lines_followed_one_by_one(spark):
    draw, fresh = random.Random(8), iter(f"line {k}" for k in range(10**6))
    files, asked = {}, []
    for f in range(6):
        versions = [[next(fresh) for _ in range(draw.choice([1, 20, 60]))]]
        for _ in range(draw.choice([0, 1, 12, 30])):
            versions.append(edited(draw, versions[-1], fresh))
        files[f"f{f}"] = versions
        n = len(versions[-1])
        asked += [(f"f{f}", f"{k}", s := draw.randint(1, n), draw.randint(s, n if k % 2 else min(n, s + 1))) for k in range(14) if n]
    want = {(f, a): w for f, a, s, e in asked if (w := plain(files[f], s, e))}
    assert ran(spark, files, asked) == want and len(want) > 12
    assert any(w[-1][-1] for w in want.values()) and any(not w[-1][-1] for w in want.values())


def test_files_go_back_side_by_side_wherever_their_rows_are_cut(monkeypatch):
    rows = []
    for f in "abcdefgh":
        rows += [(f, line_ranges.ASKED, 1 << 62, f"{f}{k}", 5 * k + 1, 5 * k + 4, 0, 0) for k in range(4)]
        rows += [(f, line_ranges.HUNK, idx, None, at, 1, at, 1) for idx in range(90, 0, -1) for at in (2, ord(f) % 16 + 3)]
    names = ("file", "kind", "idx", "ask", "a", "b", "c", "d")
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))).cast(pa.schema([(n, pa.string() if n in ("file", "ask") else pa.int64()) for n in names]))

    def went(size):
        out = list(line_ranges.carry(iter(table.to_batches(max_chunksize=size))))
        return sorted(x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), len(out)

    got, many = went(1000)
    # a commit is no batch of its own
    assert len(got) > 8 * 90 and many < 8
    for together, told, size in ((1, 1, 1), (7, 3, 2), (100, 40, 30)):
        monkeypatch.setattr(line_ranges, "TOGETHER", together)
        monkeypatch.setattr(line_ranges, "TOLD", told)
        assert went(size)[0] == got


def test_edges_of_a_range():
    one = lambda s, e, *h: tuple(int(x[0]) for x in line_ranges.step_back(np.array([s]), np.array([e]), np.array(h)))
    # behind, before, and around an insertion of lines 5 and 6
    add = (4, 0, 5, 2)
    assert one(7, 9, add) == (5, 7, 0, 0, 0) and one(1, 4, add) == (1, 4, 0, 0, 0) and one(4, 7, add) == (4, 5, 1, 2, 0)
    # all of it came with the commit; one end did
    assert one(5, 6, add)[:3] == (5, 4, 1) and one(6, 8, add) == (5, 6, 1, 1, 0) and one(2, 5, add) == (2, 4, 1, 1, 0)
    # lines 5 to 7 went from behind line 4: within the range only where it has a line on both sides
    cut = (5, 3, 4, 0)
    assert one(4, 5, cut) == (4, 8, 1, 0, 3) and one(5, 6, cut) == (8, 9, 0, 0, 0) and one(3, 4, cut) == (3, 4, 0, 0, 0)
    # a replaced block is taken whole, two hunks add up
    assert one(6, 6, (5, 4, 5, 2)) == (5, 8, 1, 1, 4)
    assert one(1, 20, (2, 1, 2, 3), (10, 2, 12, 0)) == (1, 20, 1, 3, 3)


def test_nothing_asked_and_nothing_changed(spark):
    assert ran(spark, {"f": [["a"], ["b"]]}, [("g", "x", 1, 2), ("f", "empty", 2, 1)]) == {}
    assert ran(spark, {"f": [["a"]]}, [("f", "x", 1, 1)]) == {}


def test_hunk_heads(spark):
    lines = ["@@ -3 +4,0 @@ fn x", "@@ -0,0 +1,25 @@", "--- a/x", "@@@ -1,2 -1,2 +1,3 @@@", "@@ -10,2 +9 @@"]
    got = git.parse_hunks(spark.createDataFrame([(x, 7) for x in lines], "value string, idx int"))
    assert sorted(map(tuple, got.collect())) == [(7, 0, 0, 1, 25), (7, 3, 1, 4, 0), (7, 10, 2, 9, 1)]


def test_lines_that_survive(spark):
    h = spark.createDataFrame([("f", "x", 5, 1, 3, 2, 0, True)], line_ranges.TOUCHED)
    lines = spark.createDataFrame([("f", 1, 5), ("f", 2, 5), ("f", 3, 4), ("f", 4, 5)], "file string, line_no long, idx long")
    asked = spark.createDataFrame([("f", "x", 1, 3)], "file string, ask string, start long, end long")
    assert line_ranges.surviving(h, lines, asked).first().lines == 2
