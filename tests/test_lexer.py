"""Tokens, functions, calls and complexity of many languages."""

import pytest
from pyspark.sql import functions as F

from repolith.functions import measures
from repolith.sources import lexer, walk


def kinds(text, lang):
    names = {lexer.COMMENT: "comment", lexer.STRING: "text", lexer.NUMBER: "number", lexer.NAME: "name", lexer.SIGN: "sign"}
    return [(names[t.kind], t.text, t.line) for t in lexer.tokens(text, lang) if t.kind != lexer.NEWLINE]


def test_comments_within_texts_and_texts_within_comments():
    assert kinds('a = "/* no"; // "b\nc', "java") == [("name", "a", 1), ("sign", "=", 1), ("text", '"/* no"', 1), ("sign", ";", 1), ("comment", '// "b', 1), ("name", "c", 2)]
    assert kinds("// src/*.c\nx()/* y\n*/z", "c") == [("comment", "// src/*.c", 1), ("name", "x", 2), ("sign", "(", 2), ("sign", ")", 2), ("comment", "/* y\n*/", 2), ("name", "z", 3)]
    # nested where the language nests, not elsewhere
    assert kinds("/* a /* b */ c */ d", "rust") == [("comment", "/* a /* b */ c */", 1), ("name", "d", 1)]
    assert [x[1] for x in kinds("/* a /* b */ c", "java")] == ["/* a /* b */", "c"]
    assert kinds('r##"quote "# inside"## x', "rust") == [("text", 'r##"quote "# inside"##', 1), ("name", "x", 1)]
    # a lifetime is no text, a character is
    assert [x[0] for x in kinds("&'a str '{' x", "rust")] == ["sign", "sign", "name", "name", "text", "name"]
    assert kinds("open /* never closed\n{", "go") == [("name", "open", 1), ("comment", "/* never closed\n{", 1)]
    assert kinds("--[[ long\n]] y -- z", "lua") == [("comment", "--[[ long\n]]", 1), ("name", "y", 2), ("comment", "-- z", 2)]


@pytest.mark.parametrize(("lang", "text"), [("shell", "say <<WORD\n} # { 'x\nWORD\nafter"), ("ruby", "say <<~WORD\n  end # do\n  WORD\nafter"), ("php", "$s = <<<WORD\n } \" '\nWORD;\n$after")])
def test_here_documents(lang, text):
    read = kinds(text, lang)
    assert read[-1][1].endswith("after") and read[-1][2] == 4 and "comment" not in {k for k, _, _ in read}
    assert not any(x in ("}", "{", "end", "do") for _, x, _ in read)


def told(text, lang):
    return [(f["name"], f["owner"], f["start_line"], f["end_line"]) for f in lexer.functions(text, lang)]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("rust", "impl<K> Draw for Shape<K> {\n    pub fn draw(&self) {\n        go();\n    }\n}\n#[inline]\nfn area<'x>(s: &'x str) -> f64 where f64: Copy { 1.0 }\n", [("draw", "Shape", 2, 4), ("area", None, 7, 7)]),
        ("go", "package shop\n\nfunc Price(n int) int {\n\treturn n\n}\n\nfunc (c *Cart) add(n int) {\n\tdefer c.lock()\n}\n", [("Price", None, 3, 5), ("add", "Cart", 7, 9)]),
        ("typescript", "export class Cart<T> {\n  private put(n: number): void { this.n = n }\n  get size() { return 1 }\n}\nexport const total = async (xs) => {\n  return xs.map(x => { return x })\n}\n", [("put", "Cart", 2, 2), ("size", "Cart", 3, 3), ("total", None, 5, 7)]),
        ("java", "class Cart {\n  Cart(int n) { this.n = n; }\n  @Override\n  public int size() throws E {\n    return n;\n  }\n}\n", [("Cart", "Cart", 2, 2), ("size", "Cart", 3, 6)]),
        ("cpp", "#include <map>\nnamespace shop {\nint Cart::size() const {\n  return n_;\n}\nvoid go() { int a[] = {1}; }\n}\n", [("size", "Cart", 3, 5), ("go", "shop", 6, 6)]),
        ("c", "struct cart { int n; };\nstatic int\nsize(struct cart *c)\n{\n  return c->n;\n}\n", [("size", None, 2, 6)]),
        ("csharp", "class Cart {\n  public int Size() { lock (this) { return n; } }\n}\n", [("Size", "Cart", 2, 2)]),
        ("kotlin", "object Shop {\n  val open = 1\n  fun size(c: Cart): Int {\n    return 2\n  }\n}\n", [("size", "Shop", 3, 5)]),
        ("scala", "trait Shop {\n  def size(c: Cart): Int = {\n    2\n  }\n}\n", [("size", "Shop", 2, 4)]),
        ("swift", "struct Cart {\n  init(n: Int) { self.n = n }\n  func size<T>(of x: T) -> Int { return 2 }\n}\n", [("init", "Cart", 2, 2), ("size", "Cart", 3, 3)]),
        ("dart", "int size(Cart c) {\n  return 2;\n}\n", [("size", None, 1, 3)]),
        ("php", "<?php\nclass Cart {\n  public function size() { return 2; }\n}\n", [("size", "Cart", 3, 3)]),
        ("ruby", "module Shop\n  class Cart\n    def size\n      return 1 if open?\n      @x.each do |x|\n        x\n      end\n    end\n    def self.make(n) = n\n  end\nend\n", [("size", "Cart", 3, 8)]),
        ("lua", "function Cart.size(c)\n  for k = 1, 2 do say(k) end\n  repeat c() until k\nend\nlocal add = function(n) return n end\n", [("size", "Cart", 1, 4), ("add", None, 5, 5)]),
        ("julia", "function size(c)\n  while c\n    say(c)\n  end\nend\n", [("size", None, 1, 5)]),
        ("shell", "size() {\n  say 1\n}\nfunction add {\n  say 2\n}\n", [("size", None, 1, 3), ("add", None, 4, 6)]),
        ("perl", "package Cart;\nsub size { return 1; }\n", [("size", None, 2, 2)]),
        ("r", "size <- function(c) {\n  c\n}\n", [("size", None, 1, 3)]),
        ("zig", "pub fn size(c: Cart) u32 {\n    return 2;\n}\n", [("size", None, 1, 3)]),
        ("solidity", "contract Cart {\n  function size() public returns (uint) { return 2; }\n}\n", [("size", "Cart", 2, 2)]),
        ("gdscript", "class Cart:\n\tfunc size():\n\t\treturn 2\n\nfunc _add(n):\n\tif n:\n\t\tsay(n)\n", [("size", "Cart", 2, 3), ("_add", None, 5, 7)]),
    ],
)
def test_functions_names_owners_and_lines(lang, text, want):
    assert told(text, lang) == want


@pytest.mark.parametrize(
    ("lang", "text", "cost"),
    [
        # a chain costs one a question, its other arm nothing
        ("rust", "fn f() { if p { } else if q { } else if r { } else { } }", 3),
        ("java", "void f() { if (p) x(); else if (q) y(); else z(); }", 2),
        ("perl", "sub f { if ($p) { } elsif ($q) { } else { } }", 2),
        ("lua", "function f() if p then x() elseif q then y() else z() end end", 2),
        ("ruby", "def f\n  if p\n    x\n  elsif q\n    y\n  else\n    z\n  end\nend\n", 2),
        ("gdscript", "func f():\n\tif p:\n\t\tx()\n\telif q:\n\t\ty()\n\telse:\n\t\tz()\n", 2),
        # forks within forks, and within the other arm
        ("go", "func f() {\n for p {\n  switch q {\n  case 1:\n   if r { }\n  }\n }\n}", 1 + 2 + 3),
        ("javascript", "function f() { if (p) { } else { while (q) { } } }", 1 + 2),
        ("c", "void f() { for (;;) if (p) while (q) x(); if (r) y(); }", 1 + 2 + 3 + 1),
        ("java", "void f() { do { if (p) { } } while (q); while (r) { } }", 1 + 2 + 1),
        ("csharp", "void F() { try { } catch (E e) { if (p) { } } return p ? 1 : 2; }", 1 + 2 + 1),
        ("ruby", "def f\n  while p\n    x unless q\n    case r\n    when 1 then y\n    end\n  end\nend\n", 1 + 2),
        ("julia", "function f()\n  for p in q\n    if r\n    end\n  end\n  if s\n  end\nend\n", 1 + 2 + 1),
        ("gdscript", "func f():\n\tfor p in q:\n\t\tif r:\n\t\t\tx()\n\tif s:\n\t\ty()\n", 1 + 2 + 1),
        ("swift", "func f() { guard let p = q else { return }\n if r { } }", 1 + 1),
        ("kotlin", "fun f() {\n  when (p) {\n    1 -> x()\n    else -> if (q) { y() }\n  }\n}", 1 + 2),
        # operators: a run of one costs one wherever it stands, brackets begin anew
        ("rust", "fn f() { while p { let x = a && b && c || d && e; } }", 1 + 3),
        ("go", "func f() { x := a || b || c; y := a && (b && c) }", 1 + 2),
        ("php", "<?php function f() { return $a and $b; }", 1),
        ("typescript", "function f(a?: number) { return a?.b ?? (a && 1) }", 1),
        ("c", "int f() { return a + b * c - d; }", 0),
    ],
)
def test_complexity(lang, text, cost):
    assert [f["cognitive"] for f in lexer.functions(text, lang)] == [cost]


@pytest.mark.parametrize(
    ("text", "cost"),
    [
        ("def f():\n  if p:\n    pass\n  elif q:\n    pass\n  else:\n    pass\n", 2),
        ("def f():\n  if p:\n    pass\n  else:\n    if q:\n      pass\n", 3),
        ("def f():\n  for p in q:\n    try:\n      x()\n    except E:\n      return 1 if r else 2\n", 1 + 2 + 3),
        ("def f():\n  return [x for x in y if x and z]\n", 1 + 1),
        ("def f():\n  match p:\n    case 1:\n      pass\n", 0),
        ("def f():\n  while p:\n    def g():\n      if q:\n        pass\n", 1 + 2),
    ],
)
def test_complexity_of_python(text, cost):
    assert next(walk.python_functions(text))["cognitive"] == cost


def test_calls_are_told_once_in_their_order():
    (f,) = lexer.functions("fn f() { shop::open(1); a.b.add(2); add(3); add(4); c->put(5); if (x) { } let g = |y| y; }", "rust")
    assert [(c["name"], c["via"], c["qualifier"]) for c in f["calls"]] == [("open", "path", "shop"), ("add", "dot", "b"), ("add", "free", None), ("put", "dot", "c")]
    (f,) = lexer.functions("def f\n  a.b(1)\n  c(2)\nend\n", "ruby")
    assert [(c["name"], c["via"]) for c in f["calls"]] == [("b", "dot"), ("c", "free")]
    many = "void f() { " + " ".join(f"c{k}();" for k in range(3000)) + " }"
    assert len(lexer.functions(many, "c")[0]["calls"]) == lexer.MOST_CALLS


def test_shapes_ignore_names_texts_and_comments():
    text = "function {0}({1}) {{ // {2}\n let {1} = '{2}'; if ({1} > {3}) {{ return {0}({1}, {3}); }} return {1}.map(x => x + {3}); {0}({1}); {0}({1}); }}"
    a, b = (lexer.functions(text.format(*x), "javascript")[0] for x in (("f", "a", "one", 1), ("other", "b", "two /* three", 22)))
    assert a["shape"] == b["shape"] is not None
    c = lexer.functions(text.format("f", "a", "one", 1).replace(">", "<"), "javascript")[0]
    assert c["shape"] not in (None, a["shape"])
    assert lexer.functions("function f() { return 1 }", "javascript")[0]["shape"] is None


def test_lines_with_code():
    (f,) = lexer.functions('int f() {\n\n  // a\n  x(); /* b\n  c */ y();\n  /* d */\n  s = "/*";\n}\n', "c")
    assert (f["end_line"], f["ncloc"], f["doc"]) == (8, 5, None)
    (f,) = lexer.functions("-- Adds.\n-- Well.\nfunction f()\n  --[[ x\n  y ]] z()\nend\n", "lua")
    assert (f["ncloc"], f["doc"]) == (3, "Adds.\nWell.")


@pytest.mark.parametrize("lang", sorted(lexer.SYNTAX))
def test_odd_texts_end(lang):
    for text in ["", "\n" * 5, "}" * 50, "{" * 2000, "(" * 2000 + ")" * 1000, "end\n" * 50, '"', "'", "/*", "\0\x01", "é" * 10, "if " * 500, "fn fn fn {", "x" * 100_000]:
        lexer.functions(text, lang)


def test_column_of_lines_by_language(spark):
    cases = [
        ("slashes", "// see src/*.c\na();\nb();\n/* c\nd */\ne();", 3),
        ("slashes", 's = "/*";\nt();\nu = "*/";', 3),
        ("slashes", "a /* x\ny */ b\n/* z */", 2),
        ("slashes", "# define A\n/* open\nto the end", 3),
        ("hashes", "a # b\n# c\ns = '#'\n// d", 3),
        ("python", '"""one\ntwo"""\nx = """kept\n# kept"""\n# gone', 2),
        ("any", "'''a\nb'''\n# c\n// d/*\ne", 1),
        ("any", "", 0),
    ]
    df = spark.createDataFrame([(k, body, n) for k, (_, body, n) in enumerate(cases)], "k int, body string, n int")
    for k, (how, _, n) in enumerate(cases):
        assert df.where(F.col("k") == k).select(measures.ncloc(F.col("body"), how)).first()[0] == n, cases[k]


def test_functions_of_a_table_of_files(spark):
    many = "\n".join(f"function f{k}() {{ go() }}" for k in range(1200))
    rows = [("a.js", "javascript", many), ("b.lua", "lua", "function g() end"), ("c.txt", None, "x"), ("d.py", "python", "def h(): pass"), ("e.go", "go", None), ("f.hs", "haskell", "f x = x")]
    got = walk.functions(spark.createDataFrame(rows, "path string, lang string, text string"))
    assert {r.path: r["count"] for r in got.groupBy("path").count().collect()} == {"a.js": 1200, "b.lua": 1, "d.py": 1}
