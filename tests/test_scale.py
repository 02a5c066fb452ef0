"""What a step reads, stores and sends, beside its results."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from repolith.operators import findings, graph
from repolith.plans import facts as plan
from repolith.plans.rules import Clause, Rule

NOW = "2020-03-01 00:00:00"


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture
def lines(spark):
    rows = [(p, f, a, c, f"2020-0{m}-{d:02d} 00:00:00") for p, f, a, c, m, d in [
        ("a", 1, 7, 1, 1, 1), ("a", 1, 7, 2, 2, 20), ("a", 2, 7, 2, 2, 20), ("a", 2, 8, 3, 2, 25), ("a", 2, None, 3, 2, 25),
        ("a", 1, 8, 1, 2, 28), ("b", 1, 7, 2, 2, 20), ("b", 3, None, 9, 1, 2),
    ]]
    return spark.createDataFrame(rows, "path string, func_id long, author long, commit long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_lines_are_not_copied_for_each_distinct_count(lines):
    now = F.lit(NOW).cast("timestamp")
    own, by_file, repo = plan.line_ages(lines, now, 30)
    day = F.floor(F.unix_timestamp("ts") / 86400)
    recent = F.when(day > F.floor(F.unix_timestamp(now) / 86400) - 30, F.col("commit"))
    for keys, got in ((["path", "func_id"], own), (["path"], by_file)):
        want = lines.groupBy(*keys).agg(F.countDistinct(recent).alias("commits"), F.countDistinct("author").alias("headcount"))
        assert sorted(map(tuple, got.select(*keys, "commits", "headcount").collect())) == sorted(map(tuple, want.collect()))
        assert "Expand" not in plan_of(got)
    assert repo.first()["repo_headcount"] == 2


def test_the_search_for_reached_nodes_drops_the_edges_it_has_followed(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, True), *[(k, False) for k in range(1, 8)], (8, None)], "node long, is_test boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (2, 8), (5, 6), (0, 0)], "src long, dst long")
    sizes, kept = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (sizes.append((tuple(df.columns), df.count())), kept(df))[1])
    got = {r.node: r.under_test for r in graph.under_test(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: None}
    left = [n for columns, n in sizes if set(columns) == {"src", "dst"}]
    assert left and left == sorted(left, reverse=True) and left[-1] < left[0]


def test_balance_takes_more_hits_than_it_brings_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(findings, "MOST_BALANCED", 3, raising=False)
    facts = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("func").alias("kind"), F.col("id").cast("double").alias("n"), (F.col("id") % 5).cast("double").alias("loc"), (F.col("id") % 3).cast("double").alias("callers"))
    rules = [Rule("func", (Clause("loc", ">=", 1.0),), id="a"), Rule("func", (Clause("callers", ">", 0.0),), id="b")]
    asked = []
    monkeypatch.setattr(findings, "balance_groups", lambda *a, of=findings.balance_groups: (asked.append(len(a[0])), of(*a))[1])
    got = findings.balance(facts, rules, 400)
    rows = [("a", f"k{k}", float(k % 5)) for k in range(1000) if k % 5 >= 1] + [("b", f"k{k}", float(k % 3)) for k in range(1000) if k % 3 > 0]
    assert got == findings.balance_matrix(rows, rules, 400)
    # (rule, value) rows of groups of subjects, not of subjects
    assert asked[0] <= 2 * 5 * 3


def test_text_splitters_are_those_of_all_rows(spark, monkeypatch):
    from repolith.llm import sharding

    monkeypatch.setattr(sharding, "TEXTS", 50, raising=False)
    texts = [f"{'abc'[k % 3]}{k * 7919 % 1009:04d}" if k % 50 else None for k in range(3000)] + ["same"] * 900
    df = spark.createDataFrame([(t,) for t in texts], "v string").repartition(5)
    for parts in (2, 7, 16):
        known = sorted(t for t in texts if t is not None)
        size, more = divmod(len(known), parts)
        want = sorted({known[k * size + min(k, more)] for k in range(1, parts)})
        assert sharding.text_splitters(df, "v", parts, len(texts)) == want
    assert sharding.text_splitters(df.where("v is null"), "v", 4, 60) == []
    assert sharding.text_splitters(df.where("v like 'a000%'").limit(2), "v", 8, 2) != []


def test_source_files_are_dealt_over_all_cores(spark):
    from repolith.sources import driver_tables as t

    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert t.source_files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == many


def test_rounds_are_dropped_once_nothing_reads_them(spark, tmp_path):
    from repolith.operators import lineage

    chain = spark.range(40).select(F.col("id").alias("sha"), F.lit(0).alias("nth"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    dropped, of = [], lineage.drop
    try:
        lineage.drop = lambda df: (dropped.append(1), of(df))[1]
        got = {r.sha: (r.chain, r.place) for r in lineage.chains(chain).collect()}
    finally:
        lineage.drop = of
    assert got == {k: (0, k) for k in range(40)} and len(dropped) >= 6


def test_files_that_share_a_path_are_one_file_by_place_too(spark, tmp_path):
    from repolith import queries
    from repolith.sources import driver_tables as t

    sf = "/root/testdata/sf0.001"
    for name in ("nation", "region", "part", "orders", "documents", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    # two files a path, which have no part in common
    spark.read.parquet(f"{sf}/lineitem.parquet").where("l_partkey % 2 = l_suppkey % 2").write.parquet(str(tmp_path / "lineitem.parquet"))
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    s.withColumn("s_name", F.concat(F.lit("S"), F.expr("s_suppkey div 2"))).withColumn("s_nationkey", F.lit(1).cast(s.schema["s_nationkey"].dataType)).write.parquet(str(tmp_path / "supplier.parquet"))
    sf = str(tmp_path)
    f = t.functions(spark, sf)
    placed = t.placed_functions(spark, sf, t.places(spark, sf))
    assert sorted(map(tuple, placed.select(f.columns).collect()), key=str) == sorted(map(tuple, f.collect()), key=str)
    by_place = queries.tables(spark, sf)
    by_path = plan.Tables(f, by_place.edges, by_place.nodes, t.blame_lines(spark, sf), queries.key_of_readings(spark, sf, f), by_place.now, by_place.windows)
    got, want = (sorted(map(tuple, plan.build(x).collect()), key=str) for x in (by_place, by_path))
    assert got == want and got
    by_place.versions, by_path.versions = t.placed_versions(spark, sf, placed), t.body_versions(spark, sf)
    got, want = (sorted(map(tuple, plan.build(x, ["commits"]).select("key", "commits").collect()), key=str) for x in (by_place, by_path))
    assert got == want and any(commits for _, commits in got)


def test_facts_read_nothing_for_fields_that_nobody_asked_for(spark, monkeypatch):
    from repolith import queries

    for name in ("degrees", "under_test"):
        monkeypatch.setattr(graph, name, lambda *_: 1 / 0)
    monkeypatch.setattr(plan, "line_ages", lambda *_: 1 / 0)
    assert queries.edited_facts(spark, "/root/testdata/sf0.001").where("commits > 0").count() > 0


@pytest.mark.parametrize("name", ["rule_catalog_counts", "rules_overview", "rule_mentions", "rule_report_top50", "rule_marginal_only", "merge_findings"])
def test_facts_are_stored_before_they_are_read_twice(spark, monkeypatch, name):
    from repolith import queries

    kept, of = [], getattr(graph, "stored", None)
    monkeypatch.setattr(graph, "stored", lambda df: (kept.append(of(df)), kept[-1])[1], raising=False)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    # the last one holds hits, or the subjects that four steps read
    assert kept and (kept[-1].columns[0] == "rule" or {"key", "kind"} <= set(kept[-1].columns))
