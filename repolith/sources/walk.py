"""Source trees as tables: files, functions, header comments."""

from __future__ import annotations

import ast
import keyword
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import LANGUAGES, extension, language
from . import lexer

MOST_BYTES, MOST_LINE, MOST_DOC, MOST_CALLS = 1_000_000, 2_000, 600, 2_048
SKIPPED_DIRS = (".git", "node_modules", "vendor", "target", "dist", "build")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, text, lang, ext, skipped``: every file under a folder that Spark can list.

    Hidden and vendored folders are left out; files too large or with over-long lines are skipped and say why.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^\w+:(//)?", "", root.rstrip("/"))
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    df = raw.select(path.alias("path"), F.col("length").alias("bytes"), "content")
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED_DIRS))
    df = df.where(~hidden).withColumn("text", F.when(F.col("bytes") <= MOST_BYTES, F.decode("content", "UTF-8")))
    long_line = F.exists(F.split("text", "\n"), lambda line: F.octet_length(line) > MOST_LINE)
    skipped = F.when(F.col("bytes") > MOST_BYTES, "too large").when(long_line, "minified")
    return df.select("path", "bytes", "text", language(F.col("path")).alias("lang"), extension(F.col("path")).alias("ext"), skipped.alias("skipped"))


def unscanned(files: DataFrame) -> DataFrame:
    """``by, value, files``: what was not parsed, by extension and by reason."""
    by_ext = files.where("lang is null").groupBy(F.col("ext").alias("value")).agg(F.count("*").alias("files")).withColumn("by", F.lit("extension"))
    by_why = files.where("skipped is not null").groupBy(F.col("skipped").alias("value")).agg(F.count("*").alias("files")).withColumn("by", F.lit("reason"))
    return by_ext.unionByName(by_why).select("by", "value", "files")


KEYWORDS = frozenset(keyword.kwlist)

#: Nodes that fork the flow; nesting adds to what they cost.
FORKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)


def cognitive(body: list[ast.stmt]) -> int:
    """Each fork costs one and one for every fork around it, an elif one, else nothing, each run of one logical operator one."""

    def cost(node: ast.AST, depth: int, parent_op: type | None = None) -> int:
        if isinstance(node, ast.If):
            return if_cost(node, depth, 1 + depth)
        if isinstance(node, ast.BoolOp):
            op = type(node.op)
            return int(op is not parent_op) + sum(cost(c, depth, op) for c in node.values)
        if isinstance(node, ast.comprehension):
            return cost(node.target, depth) + cost(node.iter, depth) + sum(1 + depth + cost(c, depth + 1) for c in node.ifs)
        own = 1 + depth if isinstance(node, FORKS) else 0
        inner = depth + 1 if isinstance(node, FORKS) else depth
        return own + sum(cost(c, inner) for c in ast.iter_child_nodes(node))

    def if_cost(node: ast.If, depth: int, own: int) -> int:
        total = own + cost(node.test, depth + 1) + sum(cost(c, depth + 1) for c in node.body)
        if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset:
            return total + if_cost(node.orelse[0], depth, 1)
        return total + sum(cost(c, depth + 1) for c in node.orelse)

    return sum(cost(n, 0) for n in body)


def python_functions(text: str) -> Iterator[dict]:
    """Functions of a Python file, in source order, with calls and complexity; nothing for a file that does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")
    read = lexer.tokens(text, "python")

    def visit(node: ast.AST, owner: str | None) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                start, end = child.lineno, child.end_lineno or child.lineno
                body = "\n".join(lines[start - 1 : end])
                called = {}
                for c in sorted((c for c in ast.walk(child) if isinstance(c, ast.Call)), key=lambda c: (c.func.end_lineno, c.func.end_col_offset)):
                    f = c.func
                    if isinstance(f, ast.Name):
                        called[f.id, "free", None] = None
                    elif isinstance(f, ast.Attribute):
                        called[f.attr, "dot", f.value.id if isinstance(f.value, ast.Name) else None] = None
                calls = [{"name": n, "via": v, "qualifier": q} for n, v, q in list(called)[:MOST_CALLS]]
                local = [n.name for n in ast.walk(child) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n is not child]
                doc = ast.get_docstring(child)
                told = child.body[0] if doc is not None else None
                prose = set(range(told.lineno, (told.end_lineno or told.lineno) + 1)) if told else set()
                inside = [t for t in read if start <= t.line <= end]
                yield {"name": child.name, "owner": owner, "signature": lines[start - 1].strip(), "body": body, "doc": doc, "start_line": start, "end_line": end, "ncloc": len(lexer.code_lines(inside) - prose), "cognitive": cognitive(child.body), "calls": calls, "locals": local, "exported": not child.name.startswith("_"), "shape": lexer.shape([t for t in inside if t.line not in prose and t.line > start], KEYWORDS)}
                yield from visit(child, child.name)
            elif isinstance(child, ast.ClassDef):
                yield from visit(child, child.name)
            else:
                yield from visit(child, owner)

    yield from visit(tree, None)


FUNCTIONS = "path string, lang string, name string, owner string, signature string, body string, doc string, start_line long, end_line long, loc long, ncloc long, cognitive long, calls array<struct<name:string,via:string,qualifier:string>>, locals array<string>, exported boolean, shape string"
CALLS = pa.list_(pa.struct([("name", pa.string()), ("via", pa.string()), ("qualifier", pa.string())]))
#: Columns that are not texts.
TYPES = dict.fromkeys(("start_line", "end_line", "loc", "ncloc", "cognitive"), pa.int64()) | {"calls": CALLS, "locals": pa.list_(pa.string()), "exported": pa.bool_()}
#: Functions of a record batch, so that a file of very many does not make one batch.
BATCH_FUNCTIONS = 512


def functions_of(lang: str | None, text: str) -> list[dict]:
    """The functions of a file in source order; none for a language without a table."""
    found = python_functions(text) if lang == "python" else lexer.functions(text, lang) if lang in lexer.SYNTAX else ()
    return sorted(found, key=lambda f: (f["start_line"], f["name"]))


def functions(files: DataFrame) -> DataFrame:
    """``path, lang, text`` -> a row a function. Files are parsed alone, so a large tree parses in parallel.

    Python is parsed by its grammar, the languages of ``lexer.SYNTAX`` by their tables; others give no rows.
    Null texts give none; a file that does not parse gives what could be read of it.
    """
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ \w)", FUNCTIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += ({"path": path, "lang": lang, "loc": max(0, f["end_line"] - f["start_line"] + 1), **f} for f in functions_of(lang, text))
                if len(rows) >= BATCH_FUNCTIONS:
                    yield told(rows)
                    rows = []
            yield told(rows)

    def told(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], TYPES.get(n, pa.string())) for n in names], names)

    return files.where("text is not null").select("path", "lang", "text").mapInArrow(run, FUNCTIONS)


LICENCE = re.compile(r"licen[sc]e|copyright|spdx|all rights reserved", re.I)


def header_doc(text: str) -> str | None:
    """The comment at the head of a file without its licence blocks, at most 600 characters."""
    blocks, block = [], []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("#!"):
            continue
        if s.startswith(("//", "#", "*", "/*", '"""')) or (block and block[0].startswith(('"""', "/*")) and not block[-1].endswith(('"""', "*/"))):
            block.append(s)
            if len(s) > 3 and s.endswith('"""') and s.startswith('"""'):
                blocks.append(block)
                block = []
        elif not s:
            if block:
                blocks.append(block)
                block = []
        else:
            break
    if block:
        blocks.append(block)
    kept = [b for b in blocks if not LICENCE.search(" ".join(b))]
    plain = "\n".join(re.sub(r'^(//+!?|#+|/\*+|\*+/?|""")\s?|(\*/|""")$', "", x).strip() for b in kept for x in b).strip()
    return plain[:MOST_DOC] or None


@F.pandas_udf(T.StringType())
def header_docs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: header_doc(t or ""))


def attributes(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Generated and vendored patterns of an attribute file."""
    generated, vendored = [], []
    for line in text.split("\n"):
        words = line.split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        for w in words[1:]:
            name, _, value = w.partition("=")
            if value.lower() == "false" or name.startswith("-"):
                continue
            if name == "linguist-generated":
                generated.append(words[0])
            elif name == "linguist-vendored":
                vendored.append(words[0])
    return tuple(generated), tuple(vendored)


def spans(files: DataFrame, wanted: DataFrame, most: int = 2000) -> DataFrame:
    """``key, path, name, start_line, end_line`` -> source of each span; ``moved`` if its name is not in its first three lines."""
    both = wanted.join(files.select("path", "text"), "path")
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    lines = F.slice(F.split("text", "\n"), F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    head = F.array_join(F.slice(lines, 1, 3), "\n")
    return both.select("key", F.array_join(lines, "\n").alias("source"), (~head.contains(F.col("name"))).alias("moved"))


def language_count() -> int:
    return len(set(LANGUAGES.values()))


def local_files(root: str) -> Iterator[str]:
    """Paths of a tree on the driver, for tools that run git beside it."""
    for d, dirs, names in os.walk(root):
        dirs[:] = sorted(x for x in dirs if not x.startswith(".") and x not in SKIPPED_DIRS)
        yield from (os.path.relpath(os.path.join(d, n), root) for n in sorted(names))
