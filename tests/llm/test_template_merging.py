"""Sibling branches of the template tree, on small invented hosts."""

from pyspark.sql import functions as F

from repolith.llm import url_filter


def grow(spark, paths):
    df = spark.createDataFrame([("h", p, 0) for p in paths], "host string, path string, label int")
    grown = url_filter.grow_templates(df.select("host", url_filter.shape(F.col("path")).alias("parts"), "label")).collect()
    return {"/".join(r.parts): r.template for r in grown}


def test_siblings_with_many_equal_children_merge(spark):
    found = grow(spark, [f"/{lang}/{child}" for lang in ("aa", "bb") for child in "uvwxyz"])
    assert found["aa/u"] == found["bb/u"] == "/(aa|bb)/(u|v|w|x|y|z)"  # its children are pages alike


def test_siblings_near_a_share_merge_and_far_ones_do_not(spark):
    paths = [f"/aa/{c}" for c, n in zip("uvwxy", (21, 20, 20, 20, 19)) for _ in range(n)] + [f"/bb/{c}" for c, n in zip("uvwxy", (19, 20, 20, 20, 21)) for _ in range(n)]
    found = grow(spark, paths + ["/cc/other"] * 100)
    assert found["bb/u"] == "/(aa|bb)/(u|v|w|x|y)" and found["cc/other"] == "/cc/other"


def test_siblings_over_slugs_merge(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = grow(spark, [f"/{lang}/{lang}{x}{y}" for lang in ("fr", "es") for x in letters[:5] for y in letters[:10]])
    assert set(found.values()) == {"/(es|fr)/*"}


def test_templates_go_to_the_real_depth(spark):
    deep = [f"/a/b/c/d/e/f/{end}/{k}" for end in ("g", "h/i") for k in range(5)]
    pages = spark.createDataFrame([(k, f"http://x.net{p}") for k, p in enumerate(deep)], "page_id long, url string")
    got = url_filter.judge(pages, [url_filter.Rule("block", "x.net/a/b/c/d/e/f/g/")]).collect()
    assert {(r.verdict, r.template) for r in got if r.page_id < 5} == {("block", "/a/b/c/d/e/f/g/{n}")}
    assert {r.template for r in got if r.page_id >= 5} == {"/a/b/c/d/e/f/h/i/{n}"}
