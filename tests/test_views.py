from pyspark.sql import functions as F

from repolith.functions import measures, paths
from repolith.operators import views


def test_resync(spark):
    f = spark.createDataFrame([("a", "f", 1, 3, 9, "old"), ("a", "g", 1, 9, 2, "x"), ("b", "f", 1, 1, 1, "y")], "path string, name string, ord int, start_line long, loc long, body_hash string")
    fresh = spark.createDataFrame([("f", 1, 5, 10, "new"), ("h", 1, 20, 1, "z")], "name string, ord int, start_line long, loc long, body_hash string")
    assert sorted(map(tuple, views.resync(f, fresh, "a").collect())) == [("a", "f", 1, 5, 10, "new"), ("b", "f", 1, 1, 1, "y")]


def test_validation_and_locks(spark):
    r = spark.createDataFrame([("a", True, None), ("b", True, "careful"), ("c", False, "</invoke> x"), ("d", False, None)], "id string, trap boolean, note string")
    assert {x.id: x.why for x in views.invalid_reports(r).collect()} == {"a": "trap without a note", "c": "tool syntax in the note"}
    assert views.lens_locks(r, {"notes": "note", "traps": "trap"}) == {"notes": True, "traps": True}
    assert views.lens_locks(r.where("id = 'd'"), {"notes": "note"}) == {"notes": False}


def test_small_ones(spark):
    assert views.by_need([{"rule": "a", "why": "x", "need": "n"}, {"rule": "b", "why": "x", "need": "n"}, {"rule": "c", "why": "y", "need": "m"}]) == {"n": {"rules": ["a", "b"], "why": ["x"]}, "m": {"rules": ["c"], "why": ["y"]}}
    assert views.estimate(100, 100, 1.0)["affordable"] and not views.estimate(1000, 0, 1.0)["affordable"]
    d = views.attach_unparsed(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", 3)], "path string, unparsed long"))
    assert {r.path: r.unparsed for r in d.collect()} == {"a": 3, "b": 0}


def test_sunburst_covers_the_turn(spark):
    nodes = spark.createDataFrame([("", 10), ("a", 7), ("b", 3), ("a/x", 7), ("z", 0)], "path string, weight long")
    arcs = {r.path: (r.depth, round(r.start, 6), round(r.end, 6)) for r in views.sunburst(nodes).collect()}
    assert arcs == {"": (0, 0.0, 1.0), "a": (1, 0.0, 0.7), "b": (1, 0.7, 1.0), "z": (1, 1.0, 1.0), "a/x": (2, 0.0, 0.7)}
    assert views.sunburst(nodes.limit(0)).count() == 0


def test_merge_slices(spark):
    s = spark.createDataFrame([(0, 9.0, "a"), (1, 1.0, "b"), (2, 1.0, "c"), (3, 8.0, "d"), (4, 0.5, "e"), (5, 3.0, "f")], "at int, width double, label string")
    assert sorted((r.at, r.width, r.label) for r in views.merge_slices(s, 4.0).collect()) == [(0, 9.0, "a"), (1, 2.0, "2 others"), (3, 8.0, "d"), (4, 3.5, "f")]
    assert views.first_mentions(spark.createDataFrame([("r", 2), ("r", 1)], "rule string, place int")).select(F.col("place")).collect()[0][0] == 1


def test_scope_is_inherited(spark):
    n = spark.createDataFrame([("a/b/x", 1), ("a/c/x", 2), ("ab/x", 3), ("x", 4)], "path string, id int")
    of = lambda *out: sorted(r.id for r in views.in_scope(n, spark.createDataFrame([(o,) for o in out], "path string")).collect())
    assert of("a/b") == [2, 3, 4]
    assert of("a", "x", "a") == [3]
    assert of("") == [] and of() == [1, 2, 3, 4]


def test_common_dirs(spark):
    f = [(1, "a/b/x"), (1, "a/bc/x"), (2, "a/b/x"), (2, "a/b/y"), (3, "x"), (3, "a/x"), (4, "a/b-c/x"), (4, "a/b/x"), (4, "a/b/c/x"), (5, "x"), (6, None)]
    got = paths.common_dirs(spark.createDataFrame(f, "sha int, path string"), "sha")
    assert {r.sha: r.dir for r in got.collect()} == {1: "a", 2: "a/b", 3: "", 4: "a", 5: ""}


def test_lines_without_comments(spark):
    cases = [
        ("a /* x\n y */ b", 2),
        ("/* x */\n\n  // y\n# z\na", 1),
        ('def f():\n    """One.\n\n    Two.\n    """\n    return 1', 2),
        ("'''x'''\na = '''y\nz'''", 2),
        ("", 0),
        ("/* open\na", 2),
    ]
    got = spark.createDataFrame(cases, "body string, n int").select("n", measures.ncloc(F.col("body")).alias("got"))
    assert all(r.n == r.got for r in got.collect())


def test_replay_rollup(spark):
    f = spark.createDataFrame([("a/x", 3, 1, 5), ("a/b/y", 4, 2, 9), ("z", 1, 1, 1)], "path string, loc long, funcs long, commits long")
    assert sorted(map(tuple, views.replay_rollup(f).collect())) == [("", 8, 4, 9), ("a", 7, 3, 9), ("a/b", 4, 2, 9)]
