"""Ignore files, edits of bodies, as-of joins and stored frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from repolith.operators import edits, replay
from repolith.sources import ignores

IGNORED = [
    # patterns by folder, path, whether it is left out
    ({"": "*.log"}, "a/b/x.log", True),
    ({"": "*.log"}, "a/x.log.txt", False),
    ({"": "/top"}, "top", True),
    ({"": "/top"}, "a/top", False),
    ({"": "a/b"}, "a/b", True),
    ({"": "a/b"}, "c/a/b", False),
    ({"": "out/"}, "out", False),
    ({"": "out/"}, "x/out/deep/er", True),
    ({"": "*.log\n!keep.log"}, "d/keep.log", False),
    ({"": "!keep.log\n*.log"}, "d/keep.log", True),
    # nothing below an ignored folder comes back
    ({"": "out/\n!out/keep"}, "out/keep", True),
    ({"": "out/*\n!out/keep"}, "out/keep", False),
    ({"": "out/", "out": "!*"}, "out/x", True),
    # a folder's own patterns come after those above
    ({"": "*.txt", "doc": "!*.txt"}, "doc/a.txt", False),
    ({"": "*.txt", "doc": "!*.txt"}, "src/a.txt", True),
    ({"": "!a.txt", "doc": "a.txt"}, "doc/in/a.txt", True),
    ({"doc": "/a.txt"}, "doc/in/a.txt", False),
    ({"": "**/gen/*.c"}, "x/y/gen/a.c", True),
    ({"": "**/gen/*.c"}, "gen/a.c", True),
    ({"": "x/**/z"}, "x/z", True),
    ({"": "x/**/z"}, "x/1/2/z", True),
    ({"": "x/**"}, "x/1/2", True),
    ({"": "x/**"}, "x", False),
    ({"": "a?c[0-9].[!h]"}, "abc7.c", True),
    ({"": "a?c[0-9].[!h]"}, "abc7.h", False),
    ({"": "a*c"}, "a/c", False),
    ({"": "# no\n\n   \n\\#yes\n\\!bang"}, "#yes", True),
    ({"": "# no\n\n   \n\\#yes\n\\!bang"}, "no", False),
    ({"": "\\!bang"}, "!bang", True),
    ({"": "sp ace  \r\nend\\ "}, "sp ace", True),
    ({"": "end\\ "}, "end ", True),
    ({"": "(x)+.$"}, "(x)+.$", True),
    ({"": "*"}, "any/thing", True),
    ({}, "any/thing", False),
]


def test_ignore_files(spark):
    found, paths = [], []
    for k, (told, path, _) in enumerate(IGNORED):
        # every case is a tree of its own
        found += [(f"t{k}/{folder}".rstrip("/"), text) for folder, text in told.items()]
        paths.append((f"t{k}/{path}",))
    rules = ignores.parse_ignores(spark.createDataFrame(found, "folder string, text string").repartition(3))
    gone = {r.path for r in ignores.ignored_paths(spark.createDataFrame(paths, "path string"), rules).collect()}
    wrong = [case for case, (path,) in zip(IGNORED, paths, strict=True) if (path in gone) != case[2]]
    assert not wrong


def test_kept_files_read_their_own_ignore_files(spark):
    rows = [(".gitignore", "*.o\nbuild/"), ("a/.gitignore", "!x.o"), ("a/x.o", ""), ("b/x.o", ""), ("build/.gitignore", "!*"), ("build/y", ""), ("c.c", None)]
    kept = ignores.kept_files(spark.createDataFrame(rows, "path string, text string"))
    assert {r.path for r in kept.collect()} == {".gitignore", "a/.gitignore", "a/x.o", "c.c"}
    assert ignores.kept_files(spark.createDataFrame([], "path string, text string")).count() == 0


def test_a_rewrite_in_place_counts_every_time(spark):
    day = 86400
    versions = [("f", k, k * day, f"v{k}") for k in range(12)]
    versions += [("g", 0, 0, "a"), ("g", 1, day, "a"), ("g", 2, 2 * day, None), ("g", 3, 3 * day, None), ("g", 4, 4 * day, "a"), ("g", 5, 5 * day, "b"), ("h", 1, day, None)]
    df = spark.createDataFrame([(k, "p" if k == "f" else "q", i, t, d) for k, i, t, d in versions], "key string, path string, idx long, s long, digest string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    now = F.timestamp_seconds(F.lit(11 * day))
    assert {tuple(r) for r in edits.edit_counts(df, now, [3, 90]).collect()} == {("f", 3, 12), ("g", 0, 3)}
    by_key, by_path = edits.commit_counts(df, now, 90)
    assert {tuple(r) for r in by_path.collect()} == {("p", 12), ("q", 3)} and by_key.count() == 2


def made(seed, n=400, functions=15):
    draw = random.Random(seed)
    return sorted({(draw.randrange(n), f"f{draw.randrange(functions)}"): None for _ in range(n)}), draw


@pytest.fixture(scope="module")
def deltas(spark):
    at, draw = made(1)
    rows = [(f, i, draw.choice(["set", "set", "set", "del"]), f"p{draw.randrange(4)}", draw.randrange(50)) for i, f in at]
    return rows, spark.createDataFrame(rows, "func_id string, idx long, op string, path string, loc long").repartition(4)


def state(rows, idx):
    now = {}
    for f, _, op, path, loc in sorted((r for r in rows if r[1] <= idx), key=lambda r: r[1]):
        now.pop(f, None)
        if op == "set":
            now[f] = (path, loc)
    return {(f, *v) for f, v in now.items()}


def test_as_of_join(spark, deltas):
    rows, df = deltas
    asked = [(f"f{k % 17}", k * 3 - 5, f"note {k}") for k in range(120)]
    got = replay.as_of_join(spark.createDataFrame(asked, "func_id string, idx long, note string"), df, "func_id", "op", "loc")
    assert got.columns == ["func_id", "idx", "note", "op", "loc"]
    for r in got.collect():
        last = max((x for x in rows if x[0] == r.func_id and x[1] <= r.idx), key=lambda x: x[1], default=None)
        assert (r.op, r.loc) == ((last[2], last[4]) if last else (None, None))
    assert got.count() == 120


def test_a_frame_reads_one_snapshot_and_one_tail(spark, deltas, tmp_path):
    rows, df = deltas
    folder, every = f"file://{tmp_path}/frames", 60
    replay.write_frames(df, folder, every)
    for idx in (0, 1, 59, 60, 61, 200, 359, 399):
        frame = replay.read_frame(spark, folder, idx, every)
        assert {tuple(r) for r in frame.select("func_id", "path", "loc").collect()} == state(rows, idx), idx
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"PartitionFilters: \[isnotnull\(run#\d+L?\), \(run#\d+L? = \d+\)\]", plan)) == 2
    files = {re.search(r"run=(\d+)", f)[1] for f in replay.read_frame(spark, folder, 200, every).inputFiles() if "run=" in f}
    read = spark.read.parquet(f"{folder}/states").where("run = 3").select(F.input_file_name().alias("f")).distinct().collect()
    assert all("run=3" in r.f for r in read) and files
    assert replay.spacing(0, 10_000) == 2000 and replay.spacing(0, 119_999) == 10_000
