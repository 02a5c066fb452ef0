"""Steps over large tables are dealt to as many tasks as their rows need, with the results of any other number."""

from pyspark.sql import functions as F

from repolith.functions.tasks import MOST_ROWS, tasks_for
from repolith.operators import graph, history


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tasks_grow_with_rows(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == 1 and tasks_for(spark, 30_000) == 1
    assert tasks_for(spark, MOST_ROWS * usual * 6) == usual * 6


def test_neighbours_are_dealt(spark):
    nodes = spark.createDataFrame([(k, f"d{k % 3}") for k in range(12)], "node long, dir string")
    edges = spark.createDataFrame([(k, k * 5 % 12) for k in range(11)], "src long, dst long")
    assert rows(graph.locality(nodes, edges, 7)) == rows(graph.locality(nodes, edges))


def test_commits_and_lines_are_dealt(spark):
    touched = spark.createDataFrame([(k % 9, f"a/b{k % 4}/f{k % 7}") for k in range(60)], "sha long, path string")
    dirs = history.with_dirs(touched, 7)
    assert dirs.rdd.getNumPartitions() == 7 and rows(dirs) == rows(history.with_dirs(touched))
    lines = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 5).alias("path"), F.expr("id div 5").alias("line_no"), (F.col("id") % 23).alias("commit"), (F.col("id") % 3).cast("string").alias("author"), F.timestamp_seconds("id").alias("ts"))
    assert rows(history.headcounts(lines, 7)) == rows(history.headcounts(lines))
    f = spark.createDataFrame([(f"k{k}", f"p{k % 6}", k, k + 9) for k in range(12)], "key string, path string, start_line long, end_line long")
    now = F.timestamp_seconds(F.lit(10_000))
    assert rows(history.blame_ranges(f, lines, now, 7).fillna(0)) == rows(history.blame_ranges(f, lines, now).fillna(0))
