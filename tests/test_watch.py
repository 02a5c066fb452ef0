"""Changes of a tree between two looks."""

import os

from repolith.operators import graph
from repolith.streaming import watch
from repolith.streaming.incremental import VersionedTable

FILES = "path string, size long, time long"


def told(df):
    return {(r.path, r.op) for r in df.collect()}


def test_changes_and_marks(spark):
    a = spark.createDataFrame([("same", 1, 1), ("size", 1, 1), ("time", 1, 1), ("gone", 1, 1), ("null", None, 1)], FILES)
    b = spark.createDataFrame([("null", None, 1), ("time", 1, 2), ("new", 1, 1), ("size", 2, 1), ("same", 1, 1)], FILES)
    assert told(watch.changes(a, b)) == {("size", "changed"), ("time", "changed"), ("gone", "gone"), ("new", "added")}
    mark = lambda df: tuple(watch.mark(df).first())
    assert mark(a) == mark(a.repartition(3)) != mark(b) and mark(a.limit(0)) == (0, 0)


def test_looks_are_kept_by_version(spark, tmp_path):
    root, table = tmp_path / "tree", VersionedTable(spark, f"file://{tmp_path}/looks")
    (root / "in").mkdir(parents=True)
    (root / "a.py").write_text("one")
    (root / "in" / "b.py").write_text("two")
    name = lambda df: {(r.path.rsplit("/", 1)[-1], r.op) for r in df.collect()}
    now = lambda: watch.listing(spark, str(root), "*.py")
    assert name(watch.look(table, 0, now())) == {("a.py", "added"), ("b.py", "added")}
    assert watch.look(table, 0, now()) is None and name(watch.look(table, 1, now())) == set()
    (root / "a.py").write_text("longer than one")
    (root / "in" / "b.py").unlink()
    (root / "c.py").write_text("three")
    os.utime(root / "c.py", (1, 1))
    assert name(watch.look(table, 2, now())) == {("a.py", "changed"), ("b.py", "gone"), ("c.py", "added")}


def test_neighbours_by_file(spark):
    nodes = spark.createDataFrame([(1, "a", "f", "s"), (2, "a", "g", "s"), (3, "b", "h", None), (4, "b", "i", "s"), (5, "c", "j", "t")], "node int, path string, name string, shape string")
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (1, 5), (5, 2)], "src int, dst int")
    got = {(r.side, r.path, r.here, r.nodes, tuple(r.names)) for r in graph.neighbours_by_file(edges, nodes, 1).collect()}
    assert got == {("caller", "a", True, 1, ("g",)), ("caller", "b", False, 2, ("h", "i")), ("callee", "c", False, 1, ("j",)), ("clone", "a", True, 1, ("g",)), ("clone", "b", False, 1, ("i",))}
    # a node without a shape is nobody's copy
    assert {r.side for r in graph.neighbours_by_file(edges, nodes, 3).collect()} == {"callee"}
