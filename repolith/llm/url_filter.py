"""URL filtering by host rules and path-template trees.

Urls are first reduced to shapes: host and path segments, runs of digits and long hexadecimal parts masked.
Shapes with counts are what the tree is grown from, level by level, for all hosts at once: a segment that
takes too many values under its parent becomes a wildcard unless a value is frequent on its own, and
sibling branches whose children are distributed alike, and which lean to the same verdict, are merged. A
template is rejected if the smoothed share of rejected among its labelled urls is high. Smoothing backs off
to the same shapes on other hosts, and from there to the share among all labelled urls, so hosts without
labels are judged by what others serve under such paths. All of it is DataFrame code on aggregated rows; a
host with a third of all urls is as many rows as it has shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

MOST_CHILDREN = 20
OWN_SHARE = 0.05
#: Sibling branches are alike within this total variation distance of their children.
APART = 0.25
#: The prior weighs as many labelled urls; templates at or above the purity are rejected.
PRIOR_WEIGHT = 4.0
PURITY = 0.8


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    text: str  # host/path, such as example.net/en/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; null where none does. Of equally long ones the first in the list."""
    text = action = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def shape(path: Column) -> Column:
    """The path's segments with variable parts masked."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def mask(p: Column) -> Column:
        long_hex = p.rlike(r"^[0-9A-Fa-f-]{8,}$") & p.rlike(r"[0-9]")
        return F.when(long_hex & p.rlike(r"[A-Fa-f]"), F.lit("{x}")).otherwise(F.regexp_replace(p, r"[0-9]+", "{n}"))

    return F.transform(parts, mask)


def joined(pairs: Column) -> Column:
    """``value, least`` of every value in an array of pairs ``value, other``: the least value that a chain of pairs reaches."""
    values = F.array_distinct(F.concat(pairs["value"], pairs["other"]))
    start = F.transform(values, lambda v: F.struct(v.alias("value"), v.alias("least")))

    def join(labels: Column, pair: Column) -> Column:
        ends = F.transform(F.filter(labels, lambda x: (x["value"] == pair["value"]) | (x["value"] == pair["other"])), lambda x: x["least"])
        return F.transform(labels, lambda x: F.struct(x["value"].alias("value"), F.when(F.array_contains(ends, x["least"]), F.array_min(ends)).otherwise(x["least"]).alias("least")))

    return F.aggregate(pairs, start, join)


def grow_templates(urls: DataFrame) -> DataFrame:
    """``host, parts, label`` (1 reject, 0 accept, null unknown) -> ``host, parts, template, purity`` for every shape.

    A shape's leaning is the share of rejected among its labelled urls on other hosts, smoothed by that among
    all labelled urls (a half if there are none); a template's purity is the share among its own, smoothed by
    the mean leaning of its urls. An empty table gives an empty result.
    """
    t = urls.groupBy("host", "parts").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("good"))
    t = cut(t)
    depth, prior = t.agg(F.max(F.size("parts")), F.try_divide(F.sum("bad"), F.sum(F.col("bad") + F.col("good")))).first()
    depth, prior = depth or 0, 0.5 if prior is None else prior
    shared = t.groupBy("parts").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    others = F.col("all_bad") - F.col("bad") + PRIOR_WEIGHT * F.lit(prior), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good") + PRIOR_WEIGHT
    t = t.join(shared, "parts").withColumn("leaning", others[0] / others[1]).drop("all_bad", "all_good")
    # what is known of a shape's urls, and what the leaning says of the rest
    t = t.withColumn("likely", F.col("bad") + (F.col("n") - F.col("bad") - F.col("good")) * F.col("leaning"))
    t = t.withColumn("template", F.lit(""))
    node, branch = ["host", "template"], ["host", "template", "value"]
    for d in range(depth):
        # what a shape has at this level, and at the next; null once it has ended
        t = t.withColumn("value", F.try_element_at("parts", F.lit(d + 1))).withColumn("below", F.coalesce(F.try_element_at("parts", F.lit(d + 2)), F.lit("")))
        here = t.where(F.col("value").isNotNull())
        values = here.groupBy(*branch).agg(F.sum("n").alias("n"))
        totals = values.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("total"))
        keeps = (F.col("children") <= MOST_CHILDREN) | (F.col("n") >= OWN_SHARE * F.col("total"))
        values = values.join(totals, node).select(*branch, F.when(keeps, F.col("value")).otherwise("*").alias("kept"))
        here = here.join(values, branch).drop("value").withColumnRenamed("kept", "value")

        below = here.groupBy(*branch, "below").agg(F.sum("n").alias("n"), F.sum("likely").alias("likely"))
        whole = below.groupBy(*branch).agg(F.sum("n").alias("branch_n"), F.sum("likely").alias("branch_likely"))
        kind = F.floor(F.col("branch_likely") / F.col("branch_n") * 2.999).cast("int")
        below = below.join(whole.withColumn("kind", kind), branch).withColumn("own_share", F.col("n") / F.col("branch_n"))
        # children as the next level will have them: wildcards for those that it would not keep
        size = below.where(F.col("below") != "").groupBy(*branch).agg(F.count("*").alias("children"), F.sum("n").alias("total"))
        below = below.where(F.col("value") != "*").join(size, branch, "left")
        own = (F.col("below") == "") | (F.col("children") <= MOST_CHILDREN) | (F.col("n") >= OWN_SHARE * F.col("total"))
        child = below.groupBy(*branch, "kind", F.when(own, F.col("below")).otherwise("*").alias("child")).agg(F.sum("own_share").alias("share"))
        # at most MOST_CHILDREN (or 1/OWN_SHARE) values are left under a node, each with about as many children
        alike = [*node, "kind"]
        other = child.select(*alike, "child", F.col("value").alias("other"), F.col("share").alias("other_share"))
        pairs = child.join(other, [*alike, "child"]).where(F.col("value") < F.col("other")).groupBy(*alike, "value", "other").agg(F.sum(F.least("share", "other_share")).alias("common"))
        pairs = pairs.where(1 - F.col("common") <= APART + 1e-9)
        groups = pairs.groupBy(*alike).agg(F.sort_array(F.collect_list(F.struct("value", "other"))).alias("pairs"))
        near = groups.select(*node, F.inline(joined(F.col("pairs"))))
        names = Window.partitionBy(*node, "least")
        near = near.withColumn("merged", F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_set("value").over(names)), "|"), F.lit(")"))).drop("least")
        here = here.join(near, branch, "left").withColumn("grown", F.concat("template", F.lit("/"), F.coalesce("merged", "value")))
        ended = t.where(F.col("value").isNull()).withColumn("grown", F.col("template"))
        columns = ["host", "parts", "n", "bad", "good", "leaning", "likely", F.col("grown").alias("template")]
        t = cut(here.select(*columns).unionByName(ended.select(*columns)))
    leaning = F.sum(F.col("n") * F.col("leaning")) / F.sum("n")
    purity = (F.sum("bad") + PRIOR_WEIGHT * leaning) / (F.sum("bad") + F.sum("good") + PRIOR_WEIGHT)
    rates = t.groupBy("host", "template").agg(purity.alias("purity"))
    return t.select("host", "parts", "template").join(rates, ["host", "template"])


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    The longest rule that fits decides; urls that rules decide are the labels of the template tree, and it
    decides the rest. Null urls and urls without ``://`` have an empty host and path and the empty template.
    Hosts without labelled urls are judged by the same shapes on other hosts, and shapes that no label has
    shown by the share of rejected among all labelled urls (a half if there are none). Rows repeat as they
    come and extra columns are not read; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"), shape(F.col("path")).alias("parts"))
    label = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    templates = grow_templates(rows.select("host", "parts", label.alias("label")))
    judged = rows.join(templates, ["host", "parts"], "left")
    verdict = F.coalesce("action", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
