"""What a file is: code, header, generated, vendored or test, and why it is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the conventions.
BANNERS = ("do not edit", "@generated", "code generated by", "autogenerated", "automatically generated")
HEADERS = (".h", ".hpp", ".hh", ".hxx", ".pyi", ".idl")
VENDOR_DIRS = ("vendor", "node_modules", "third_party", "Godeps")
GENERATED_DIRS = ("generated", "__generated__", "antlr")
GENERATED_MARKS = (".gen.", ".pb.", "_pb2.", ".min.")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "e2e")
TEST_MARKS = (".test.", ".spec.", "_test.", "_spec.")
BANNER_CHARS = 400


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def has_mark(name: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | name.contains(m)
    return out


def glob_matches(pattern: str, path: Column) -> Column:
    """A pattern of an attribute file: a path, a directory, or one star; ``?`` and ``[`` match nothing."""
    p = pattern.lstrip("/")
    if "?" in p or "[" in p:
        return F.lit(False)
    head, star, tail = p.partition("*")
    if not star:
        return (path == p) | path.startswith(p.rstrip("/") + "/")
    tail = tail.lstrip("*").lstrip("/")
    return path.startswith(head) & (path.endswith(tail) if tail else F.lit(True))


def code_kind(path: Column, head: Column, generated: tuple[str, ...] = (), vendored: tuple[str, ...] = ()) -> Column:
    """``struct<kind, how>``: what attributes say, then a banner, then the name, then its directories; null if nothing does."""
    name = file_name(path)
    of = lambda kind, how: F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("how"))
    out = F.when(has_segment(path, GENERATED_DIRS) | has_mark(name, GENERATED_MARKS), of("generated", "convention"))
    out = F.when(has_segment(path, VENDOR_DIRS), of("vendored", "convention")).otherwise(out)
    ends = F.lit(False)
    for e in HEADERS:
        ends = ends | name.endswith(e)
    out = F.when(ends, of("header", "convention")).otherwise(out)
    out = F.when(name.endswith(".d.ts"), of("header", "contract")).otherwise(out)
    banner = F.lower(F.coalesce(F.substring(head, 1, BANNER_CHARS), F.lit("")))
    out = F.when(has_mark(banner, BANNERS), of("generated", "contract")).otherwise(out)
    for patterns, kind in ((vendored, "vendored"), (generated, "generated")):
        for p in patterns:
            out = F.when(glob_matches(p, path), of(kind, "contract")).otherwise(out)
    return out


def exclusion(path: Column, excluded: Column, kind: Column) -> Column:
    """Why a file is no subject: excluded, generated, vendored or test; null for our own code."""
    name = file_name(path)
    dirs = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    out = F.when(has_segment(dirs, TEST_DIRS) | has_mark(name, TEST_MARKS) | name.startswith("test_"), "test")
    out = F.when(has_segment(dirs, GENERATED_DIRS) | has_mark(name, GENERATED_MARKS), "generated").otherwise(out)
    out = F.when(has_segment(dirs, ("vendor", "node_modules")), "vendored").otherwise(out)
    return F.when(excluded, "excluded").when(kind.isin("generated", "vendored", "test"), kind).otherwise(out)


def testness(lang: Column, path: Column, name: Column, in_cfg_test: Column, declared: Column | None = None) -> Column:
    """``struct<is_test, how>``: the language's contract, then path and name conventions, then what is declared; null if none."""
    file, none = file_name(path), F.lit(None).cast("struct<is_test:boolean,how:string>")
    of = lambda test, how: F.struct(test.alias("is_test"), F.lit(how).alias("how"))
    contract = F.when(lang == "rust", of(F.coalesce(in_cfg_test, F.lit(False)) | path.startswith("tests/") | path.contains("/tests/"), "contract")).when(lang == "go", of(file.endswith("_test.go"), "contract"))
    python = file.startswith("test_") | file.endswith("_test.py") | (file == "conftest.py") | has_segment(path, ("tests", "test"))
    script = has_mark(file, TEST_MARKS) | has_segment(path, ("__tests__", "tests"))
    ruby = file.endswith("_spec.rb") | file.endswith("_test.rb") | has_segment(path, ("spec",))
    convention = (
        F.when(lang == "python", of(python, "convention"))
        .when(lang.isin("typescript", "tsx", "javascript"), of(script, "convention"))
        .when(lang == "ruby", of(ruby, "convention"))
        .when(lang.isin("java", "kotlin", "scala"), of(path.contains("/src/test/"), "convention"))
    )
    named = F.when(lang.isin("shell", "zsh") & (name.startswith("TEST_") | name.startswith("test_")), of(F.lit(True), "convention"))
    told = F.when(declared, of(F.lit(True), "declared")) if declared is not None else none
    return F.coalesce(contract, convention, named, told, none)


#: Extensions of the languages that the engine names.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "mts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "javascript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java",
    "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "sh": "shell", "bash": "shell", "zsh": "zsh",
    "lua": "lua", "pl": "perl", "r": "r", "jl": "julia", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "dart": "dart",
    "zig": "zig", "nim": "nim", "sql": "sql", "clj": "clojure", "elm": "elm", "vue": "vue", "svelte": "svelte", "html": "html", "css": "css", "scss": "scss", "m": "objc",
    "mm": "objc", "f90": "fortran", "d": "d", "groovy": "groovy", "ps1": "powershell", "tf": "hcl", "proto": "protobuf", "nix": "nix", "v": "verilog", "sv": "verilog",
}


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))
