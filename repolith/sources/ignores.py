"""Ignore files: which paths of a tree its own patterns leave out.

Every folder may hold patterns. For a path, and for each folder on the way to it, the patterns of all folders above are
asked from the root down, in the order of their files, and the last that matches decides; ``!`` takes back. What lies
below an ignored folder stays ignored, whatever is said further down. Each folder is decided once, not once a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

RULES = "folder string, nth int, pattern string, keeps boolean, folders boolean"


def pattern_of(glob: str) -> str:
    """The regular expression that a pattern stands for, over paths from its folder."""
    # a slash other than the last ties the pattern to its folder
    tied = "/" in glob.rstrip("/")
    glob = glob.strip("/")
    out, k = "" if tied else "(?:.*/)?", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.+", k + 3
            continue
        if c == "*":
            while glob.startswith("*", k + 1):
                k += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            told = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"(?!/)[{'^' + told[1:] if told[0] in '!^' else told}]"
            k = end
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 1
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def rules_of(folder: str, text: str) -> Iterator[tuple[str, int, str, bool, bool]]:
    for nth, line in enumerate(text.split("\n")):
        line = line.rstrip("\r")
        # blanks at the end count only behind a backslash
        while line.endswith((" ", "\t")) and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line
        if line.strip("/"):
            yield folder, nth, pattern_of(line), keeps, line.endswith("/")


def parse_ignores(found: DataFrame) -> DataFrame:
    """``folder, text`` (a row an ignore file; the root's folder is empty) -> a row a pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = [r for folder, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rules_of(folder or "", text or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split(" ")[0] for x in RULES.split(", ")])

    return found.select("folder", "text").mapInArrow(run, RULES)


def relative(path: Column, folder: Column) -> Column:
    return F.when(folder == "", path).otherwise(F.substring(path, F.length(folder) + 2, F.length(path)))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``path`` of all that the rules leave out, of the files in ``paths`` (``path``, without a leading slash)."""
    files = paths.select("path").distinct()
    above = files.select(F.explode(F.filter(ancestors(F.col("path")), lambda d: d != "")).alias("path")).distinct()
    # a folder has one row, however many files lie below it
    nodes = above.withColumn("folder", F.lit(True)).unionByName(files.withColumn("folder", F.lit(False)))
    asked = nodes.select("path", "folder", F.explode(ancestors(F.col("path"))).alias("by"))
    r = rules.select(F.col("folder").alias("by"), "nth", "pattern", "keeps", "folders")
    hits = asked.join(r, "by").where((F.col("folder") | ~F.col("folders")) & F.expr("rlike(" + "CASE WHEN by = '' THEN path ELSE substring(path, length(by) + 2) END, pattern)"))
    last = hits.groupBy("path", "folder").agg(F.max_by("keeps", F.struct(F.length("by"), "nth")).alias("keeps")).where("not keeps")
    shut = last.where("folder").select(F.col("path").alias("up"))
    under = files.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(shut, "up", "left_semi").select("path")
    return under.unionByName(last.where("not folder").select("path")).distinct()


def kept_files(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``files`` (``path, text``, among them the ignore files) without what is ignored; columns as they came."""
    own = files.where((F.substring_index("path", "/", -1) == name) & F.col("text").isNotNull())
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rules = parse_ignores(own.select(folder.alias("folder"), "text"))
    return files.join(ignored_paths(files, rules), "path", "left_anti")
