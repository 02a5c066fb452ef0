"""Paths and subject keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column, itself: bool = False) -> Column:
    """The directories above a path, the root ``''`` first; with ``itself`` the path as well."""
    parts = F.split(path, "/")
    upto = F.size(parts) - (0 if itself else 1)
    inner = F.when(upto >= 1, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), inner)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def inside(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies under it; the empty scope holds all."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def subject_key(path: Column, name: Column, ordinal: Column) -> Column:
    """``path#name``, with the ordinal from the second of a name on."""
    return F.concat(path, F.lit("#"), name, F.when(ordinal >= 2, F.concat(F.lit("#"), ordinal.cast("string"))).otherwise(F.lit("")))


def numbered(functions: DataFrame, *order: str, at: str = "path") -> DataFrame:
    """Adds ``ord``: the place of a function among those of its name in its file, which ``at`` tells."""
    return functions.withColumn("ord", F.row_number().over(Window.partitionBy(at, "name").orderBy(*order)))


def number_names(functions: DataFrame, *order: str) -> DataFrame:
    """Adds ``ord`` and ``key``: the place of a function among those of its name in its file. Number before filtering."""
    return numbered(functions, *order).withColumn("key", subject_key(F.col("path"), F.col("name"), F.col("ord")))


def common_dir(paths: list[str]) -> str:
    """The deepest directory that holds all of the paths."""
    shared: list[str] | None = None
    for p in paths:
        parts = p.split("/")[:-1]
        shared = parts if shared is None else shared[: next((k for k, (a, b) in enumerate(zip(shared, parts, strict=False)) if a != b), min(len(shared), len(parts)))]
    return "/".join(shared or [])


def common_dirs(files: DataFrame, by: str) -> DataFrame:
    """``by, dir``: the deepest directory that holds all paths of a group; two strings a group are kept, not its paths."""
    dirs = F.concat(parent(F.col("path")), F.lit("/"))
    ends = files.where("path is not null").groupBy(by).agg(F.min(dirs).alias("a"), F.max(dirs).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    steps = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    same = F.coalesce(F.array_max(F.filter(steps, lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))), F.lit(0))
    return ends.select(by, F.regexp_replace(F.array_join(F.slice(a, 1, same), "/"), "/$", "").alias("dir"))
