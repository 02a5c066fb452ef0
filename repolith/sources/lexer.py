"""One table-driven lexer, and functions by three kinds of blocks: braces, indentation, a closing keyword.

A language is a row of a table: how comments and strings begin and end, which words open a function, fork the flow
or continue a fork, and how blocks are closed. The lexer reads a file once, left to right, so a comment sign within
a string is no comment and a brace within a comment opens nothing. Everything that is read of a function comes from
its tokens: its name and owner, its lines with code, its calls, its complexity and its shape.

What a fork costs: one, and one for every fork around it; a continuation (``else if``, ``elif``) one; ``else``
nothing; and every run of one logical operator one, wherever it stands.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

MOST_CALLS, LEAST_SHAPE_TOKENS = 2_048, 40
SPACE, NEWLINE, COMMENT, STRING, NUMBER, NAME, SIGN = range(7)

C_BLOCK = (("/*", "*/"),)
DOUBLE, SINGLE, TICKS = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*`?"
TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
#: A character between quotes, which a lifetime or a type variable is not.
CHARACTER = r"'(?:\\(?:u\{[0-9a-fA-F]*\}|[^\n])[^'\n]{0,8}|[^'\\\n])'"


@dataclass(frozen=True)
class Syntax:
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = C_BLOCK
    nested: bool = False
    strings: tuple[str, ...] = (DOUBLE, SINGLE)
    #: how a block ends: "brace", "end" or "indent"
    close: str = "brace"
    #: words before a function's name; without one a name before parentheses and a brace is a function
    heads: frozenset[str] = frozenset()
    bare: bool = False
    forks: frozenset[str] = frozenset("if for while".split())
    chains: frozenset[str] = frozenset()
    owners: frozenset[str] = frozenset("class".split())
    #: words that a closing keyword ends, where blocks end so
    openers: frozenset[str] = frozenset()
    logic: tuple[frozenset[str], frozenset[str]] = (frozenset(["&&"]), frozenset(["||"]))
    ternary: bool = False
    arrows: bool = False
    heredoc: str = ""
    names: str = r"[^\W\d]\w*"
    #: further words that stand before parentheses and call nothing
    words: frozenset[str] = frozenset()
    #: whether a line's end ends a statement
    lines: bool = False

    @property
    def no_names(self) -> frozenset[str]:
        return NO_CALLS | self.heads | self.forks | self.chains | self.words


def words(told: str) -> frozenset[str]:
    return frozenset(told.split())


C_FORKS = words("if for while do switch catch")
TYPES = words("class struct interface enum union namespace trait impl extension protocol object module record contract library actor mixin")
WORD_LOGIC = (words("and"), words("or"))
BOTH_LOGIC = (words("and &&"), words("or ||"))
NONE_LOGIC = (frozenset(), frozenset())
SCRIPT = Syntax(strings=(DOUBLE, SINGLE, TICKS), heads=words("function"), bare=True, arrows=True, forks=C_FORKS, owners=TYPES, ternary=True, names=r"[^\W\d$][\w$]*|\$[\w$]*", lines=True)
C_LIKE = Syntax(bare=True, forks=C_FORKS, owners=TYPES, ternary=True, strings=(DOUBLE, CHARACTER, SINGLE))
HASH = Syntax(line=("#",), block=())

#: How each language is written; fixed values of the languages.
SYNTAX: dict[str, Syntax] = {
    "rust": Syntax(nested=True, strings=(r'b?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)', r'"(?:\\[\s\S]|[^"\\])*"?', CHARACTER), heads=words("fn"), forks=words("if for while loop match"), owners=TYPES),
    "go": Syntax(strings=(DOUBLE, CHARACTER, r"`[^`]*`?"), heads=words("func"), forks=words("if for switch select"), owners=words("struct interface"), words=words("go defer range"), lines=True),
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "java": Syntax(bare=True, words=words("synchronized"), forks=C_FORKS, owners=TYPES, ternary=True, strings=(TRIPLE, DOUBLE, SINGLE)),
    "csharp": Syntax(bare=True, words=words("lock using fixed checked unchecked"), forks=words("if for foreach while do switch catch"), owners=TYPES, ternary=True, strings=(r'\$?@"(?:""|[^"])*"?', TRIPLE, DOUBLE, CHARACTER)),
    "c": C_LIKE,
    "cpp": C_LIKE,
    "objc": C_LIKE,
    "kotlin": Syntax(lines=True, nested=True, heads=words("fun"), forks=words("if for while do when catch"), owners=TYPES, strings=(TRIPLE, DOUBLE, SINGLE)),
    "scala": Syntax(lines=True, nested=True, heads=words("def"), forks=words("if for while match catch"), owners=TYPES, strings=(TRIPLE, DOUBLE, CHARACTER)),
    "swift": Syntax(lines=True, nested=True, heads=words("func init"), forks=words("if for while repeat switch catch guard"), owners=TYPES, strings=(TRIPLE, DOUBLE), ternary=True, logic=NONE_LOGIC),
    "dart": Syntax(nested=True, bare=True, forks=C_FORKS, owners=TYPES, ternary=True, strings=(TRIPLE, r"'''[\s\S]*?(?:'''|\Z)", DOUBLE, SINGLE)),
    "php": Syntax(line=("//", "#"), heads=words("function"), forks=words("if for foreach while do switch catch"), chains=words("elseif"), owners=TYPES, ternary=True, heredoc=r"<<<[ \t]*[\"']?(\w+)[\"']?", names=r"\$?[^\W\d]\w*", logic=BOTH_LOGIC),
    "zig": Syntax(block=(), heads=words("fn"), forks=words("if for while switch"), owners=words("struct enum union"), strings=(DOUBLE, SINGLE, r"\\\\[^\n]*"), logic=WORD_LOGIC),
    "solidity": Syntax(heads=words("function constructor modifier"), forks=words("if for while do catch"), owners=TYPES),
    "groovy": Syntax(lines=True, bare=True, heads=words("def"), forks=words("if for while switch catch"), owners=TYPES, strings=(TRIPLE, DOUBLE, SINGLE)),
    "shell": Syntax(lines=True, line=("#",), block=(), strings=(r'"(?:\\[\s\S]|[^"\\])*"?', r"'[^']*'?"), heads=words("function"), bare=True, forks=words("if for while case"), chains=words("elif"), owners=frozenset(), heredoc=r"<<[-~]?[ \t]*[\"']?(\w+)[\"']?", names=r"[^\W\d][\w-]*", logic=NONE_LOGIC),
    "perl": Syntax(line=("#",), block=(("\n=pod", "\n=cut"),), heads=words("sub"), forks=words("if unless while until for foreach"), chains=words("elsif"), owners=words("package"), names=r"[$@%&]?[^\W\d]\w*", logic=NONE_LOGIC),
    "r": Syntax(lines=True, line=("#",), block=(), heads=words("function"), forks=words("if for while repeat"), owners=frozenset(), names=r"[^\W\d][\w.]*", logic=NONE_LOGIC),
    "ruby": Syntax(line=("#",), block=(("\n=begin", "\n=end"),), close="end", heads=words("def"), forks=words("if unless while until for case rescue"), chains=words("elsif"), owners=words("class module"), openers=words("def class module if unless while until for case begin do"), logic=BOTH_LOGIC, heredoc=r"<<[-~][\"'`]?(\w+)[\"'`]?", names=r"[@$]{0,2}[^\W\d]\w*[?!]?"),
    "lua": Syntax(line=("--",), block=(("--[[", "]]"),), close="end", strings=(r"\[\[[\s\S]*?(?:\]\]|\Z)", DOUBLE, SINGLE), heads=words("function"), forks=words("if for while repeat"), chains=words("elseif"), owners=frozenset(), openers=words("function if do repeat"), logic=NONE_LOGIC),
    "julia": Syntax(line=("#",), block=(("#=", "=#"),), nested=True, close="end", strings=(TRIPLE, DOUBLE, CHARACTER), heads=words("function macro"), forks=words("if for while catch"), chains=words("elseif"), owners=words("module struct"), openers=words("function macro if for while let begin try struct module do quote"), logic=NONE_LOGIC, names=r"[^\W\d]\w*!?"),
    "gdscript": Syntax(line=("#",), block=(), close="indent", strings=(TRIPLE, DOUBLE, SINGLE), heads=words("func"), forks=words("if for while match"), chains=words("elif"), owners=words("class"), logic=NONE_LOGIC),
    "python": Syntax(line=("#",), block=(), close="indent", strings=(r"[rbufRBUF]{0,2}" + TRIPLE, r"[rbufRBUF]{0,2}'''[\s\S]*?(?:'''|\Z)", r"[rbufRBUF]{0,2}" + DOUBLE, r"[rbufRBUF]{0,2}" + SINGLE), heads=words("def"), forks=words("if for while except"), chains=words("elif"), owners=words("class"), logic=WORD_LOGIC),
}
SYNTAX["zsh"] = SYNTAX["shell"]

#: Words that stand before parentheses and call nothing.
NO_CALLS = words("if for while switch catch return sizeof match when else do try foreach elif elsif elseif unless until and or not in is new throw throws await yield typeof case with lambda where super assert except")
OPEN, CLOSED = {"(": ")", "[": "]"}, {")", "]"}


@dataclass(slots=True)
class Token:
    kind: int
    text: str
    start: int
    line: int


@functools.cache
def pattern(lang: str) -> re.Pattern[str]:
    s = SYNTAX[lang]
    starts = sorted([a for a, _ in s.block] + list(s.line), key=len, reverse=True)
    parts = [rf"(?P<comment>{'|'.join(map(re.escape, starts))})"]
    if s.heredoc:
        parts.append(rf"(?P<heredoc>{s.heredoc})")
    parts += [rf"(?P<string>{'|'.join(s.strings)})", r"(?P<newline>\n)", r"(?P<space>[^\S\n]+)", rf"(?P<name>{s.names})", r"(?P<number>\d[\w.]*)", r"(?P<sign>=>|->|::|\?\.|\?\?|&&=?|\|\|=?|[=!<>]=|:=|[^\w\s])"]
    return re.compile("|".join(parts))


def tokens(text: str, lang: str) -> list[Token]:
    """All tokens of a text but white space; unclosed comments and strings end with it."""
    s, match, out = SYNTAX[lang], pattern(lang).match, []
    ends = dict(s.block)
    at, line, waiting = 0, 1, []
    while at < len(text):
        m = match(text, at)
        if not m:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "hashes":
            kind = "string"
        if kind == "comment":
            close = ends.get(m[0])
            if close is None:
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
            elif s.nested:
                depth, sign = 1, re.compile(f"{re.escape(m[0])}|{re.escape(close)}")
                while depth and (x := sign.search(text, end)):
                    depth, end = depth + (1 if x[0] == m[0] else -1), x.end()
                end = len(text) if depth else end
            else:
                end = text.find(close, end)
                end = len(text) if end < 0 else end + len(close)
            out.append(Token(COMMENT, text[at:end], at, line))
        elif m.groupdict().get("heredoc"):
            waiting.append(m.group(m.re.groupindex["heredoc"] + 1))
            out.append(Token(STRING, text[at:end], at, line))
        elif kind == "newline":
            out.append(Token(NEWLINE, "\n", at, line))
            while waiting:
                # the text of a here-document begins on the next line and ends with its word alone
                x = re.compile(rf"^[ \t]*{re.escape(waiting.pop(0))}\b", re.M).search(text, end)
                stop = x.end() if x else len(text)
                out.append(Token(STRING, text[end:stop], end, line + 1))
                line += text.count("\n", end, stop)
                end = stop
                if waiting:
                    end = text.find("\n", end) + 1 or len(text)
        elif kind != "space":
            out.append(Token({"string": STRING, "name": NAME, "number": NUMBER}.get(kind, SIGN), m[0], at, line))
        line += text.count("\n", at, end) if kind != "newline" else 1
        at = end
    return out


def code_lines(some: list[Token]) -> set[int]:
    """The lines that hold more than white space and comments."""
    out = set()
    for t in some:
        if t.kind == STRING and "\n" in t.text:
            out.update(t.line + k for k, x in enumerate(t.text.split("\n")) if x.strip())
        elif t.kind not in (COMMENT, NEWLINE):
            out.add(t.line)
    return out


def shape(some: list[Token], keywords: frozenset[str]) -> str | None:
    """A digest that names, literals and comments do not change; null under 40 tokens."""
    kept = ["$" if t.kind in (STRING, NUMBER) else "#" if t.kind == NAME and t.text not in keywords else t.text for t in some if t.kind not in (COMMENT, NEWLINE)]
    return hashlib.sha256("\x1f".join(kept).encode()).hexdigest() if len(kept) >= LEAST_SHAPE_TOKENS else None


def calls_of(some: list[Token], s: Syntax, inner: set[int]) -> list[dict]:
    """Each way a name is called, once, in the order of the text; ``inner`` are places of names that are defined there."""
    code = [t for t in some if t.kind not in (COMMENT, NEWLINE)]
    out: dict[tuple[str, str, str | None], None] = {}
    for k, a in enumerate(code[:-1]):
        if a.kind != NAME or code[k + 1].text != "(" or a.text in s.no_names or a.start in inner:
            continue
        before = code[k - 1].text if k else ""
        if before in s.heads:
            continue
        via = "dot" if before in (".", "->", "?.") else "path" if before == "::" else "free"
        left = code[k - 2] if via != "free" and k > 1 else None
        out[a.text, via, left.text if left and left.kind == NAME else None] = None
        if len(out) == MOST_CALLS:
            break
    return [{"name": n, "via": v, "qualifier": q} for n, v, q in out]


def logic_cost(code: list[Token], s: Syntax) -> int:
    """Runs of logical operators: one for all of the weaker one in an expression, one for each run of the stronger."""
    both, either = s.logic
    if not both and not either:
        return 0
    total, stack = 0, []
    # (runs of "and" so far, whether one is open, whether there was an "or")
    now = [0, False, False]
    for t in code:
        if t.text in both and t.kind != STRING:
            if not now[1]:
                now = [now[0] + 1, True, now[2]]
        elif t.text in either and t.kind != STRING:
            now = [now[0], False, True]
        elif t.text in ("(", "["):
            stack.append(now)
            now = [0, False, False]
        elif t.text in CLOSED:
            total += now[0] + now[2]
            now = stack.pop() if stack else [0, False, False]
        elif t.text in (";", "{", "}", ",", "=", ":=", "?", ":", "=>", "then", "do", "return", "if", "elif", "elsif", "elseif", "while", "unless", "until"):
            total += now[0] + now[2]
            now = [0, False, False]
    return total + sum(x[0] + x[2] for x in [*stack, now])


def is_ternary(code: list[Token], k: int, text: str) -> bool:
    t = code[k]
    return t.text == "?" and t.start > 0 and text[t.start - 1] in " \t\n)" and text[t.start + 1 : t.start + 2] in (" ", "\n", "\t")


def braced_cost(code: list[Token], s: Syntax, text: str) -> int:
    """Forks of a body with braces; a fork lasts to the end of its statement, its ``else`` included."""
    total = logic_cost(code, s)
    depth = 0  # of parentheses
    frames: list[dict] = []  # forks around, innermost last: {word, depth, blocks}
    blocks: list[dict | None] = []  # open braces and the fork each belongs to

    def after(k: int) -> str:
        return code[k + 1].text if k + 1 < len(code) else ""

    def ended(k: int) -> None:
        """A statement has ended here: so have the forks whose body it was."""
        while frames and frames[-1]["depth"] == depth and not frames[-1]["open"]:
            word = frames[-1]["word"]
            if after(k) == "else" and word in ("if", "unless", "guard", "elif", "for", "while"):
                return
            if word in ("do", "repeat") and after(k) == "while" and "tail" not in frames[-1]:
                frames[-1]["tail"] = True
                return
            if after(k) in s.chains:
                return
            frames.pop()

    for k, t in enumerate(code):
        x = t.text
        if t.kind == NAME and x in s.chains:
            total += 1
        elif t.kind == NAME and x in s.forks and (k == 0 or code[k - 1].text not in (".", "::", "?.")) and after(k) not in (":", "=>", ","):
            if x == "while" and frames and frames[-1].get("tail"):
                # the condition of a loop that has been counted
                frames[-1]["tail"] = False
                continue
            if k and code[k - 1].text == "else":
                total += 1
                if not frames:
                    frames.append({"word": x, "depth": depth, "open": 0})
            else:
                total += 1 + len(frames)
                frames.append({"word": x, "depth": depth, "open": 0})
        elif s.ternary and is_ternary(code, k, text):
            total += 1 + len(frames)
        elif x in OPEN and t.kind == SIGN:
            depth += 1
        elif x in CLOSED and t.kind == SIGN:
            depth = max(0, depth - 1)
            # a fork within parentheses ends with them
            while frames and frames[-1]["depth"] > depth and not frames[-1]["open"]:
                frames.pop()
        elif x == "{" and t.kind == SIGN:
            own = frames[-1] if frames and frames[-1]["depth"] == depth and not frames[-1]["open"] else None
            if own:
                own["open"] += 1
            blocks.append((own, depth))
        elif x == "}" and t.kind == SIGN:
            if blocks:
                own, back = blocks.pop()
                depth = back
                if own:
                    while frames and frames[-1] is not own:
                        frames.pop()
                    own["open"] -= 1
                    ended(k)
                elif not (k + 1 < len(code) and after(k) in (")", ",", ".", ";")):
                    ended(k)
        elif x == ";" and t.kind == SIGN:
            ended(k)
    return total


def statement_starts(k: int, code: list[Token]) -> bool:
    """Whether a word opens a block there, instead of standing behind a statement as its condition."""
    if k == 0:
        return True
    before = code[k - 1]
    return before.kind == NEWLINE or before.text in (";", "=", "(", "[", ",", "then", "do", "else", "begin", "return", "||", "&&", "and", "or", "{", "|", "=>", "not")


def is_endless(some: list[Token], k: int) -> bool:
    """Whether the definition at k is one of a single expression, which nothing closes."""
    j = k + 1
    while j + 1 < len(some) and (some[j].kind == NAME or some[j].text == "."):
        j += 1
    if j < len(some) and some[j].text == "(":
        j = close_of(some, j) + 1
    return j < len(some) and some[j].text == "=" and some[j - 1].start + len(some[j - 1].text) < some[j].start


def keyword_blocks(some: list[Token], s: Syntax, ruby: bool) -> Iterator[tuple[int, int, str]]:
    """(first token, last token, word) of every block that a keyword closes, inner ones first; tokens keep their line ends."""
    stack: list[tuple[int, str]] = []
    loop_line = -1
    for k, t in enumerate(some):
        if t.kind != NAME:
            continue
        x = t.text
        before = some[k - 1].text if k else ""
        if before in (".", ":", "::") and not (before == ":" and not ruby):
            continue
        if x == "end" or (x == "until" and stack and stack[-1][1] == "repeat"):
            if stack:
                start, word = stack.pop()
                yield start, k, word
        elif x in s.openers:
            if x == "do" and loop_line == t.line:
                loop_line = -1
                continue
            if ruby and x in ("if", "unless", "while", "until", "rescue") and not statement_starts(k, some):
                continue
            if x in ("while", "until", "for"):
                loop_line = t.line
            if ruby and x == "def" and is_endless(some, k):
                continue
            stack.append((k, x))


def worded_cost(some: list[Token], s: Syntax, ruby: bool) -> int:
    """Forks of a body whose blocks a keyword closes."""
    code = [t for t in some if t.kind != COMMENT]
    total = logic_cost([t for t in code if t.kind != NEWLINE], s)
    spans = {a: b for a, b, _ in keyword_blocks(code, s, ruby)}
    ends: list[int] = []
    for k, t in enumerate(code):
        while ends and k > ends[-1]:
            ends.pop()
        before = code[k - 1].text if k else ""
        if t.kind != NAME or before in (".", "::") or (t.text not in s.forks and t.text not in s.chains):
            continue
        if t.text in s.chains:
            total += 1
        elif k in spans:
            total += 1 + len(ends)
            ends.append(spans[k])
        elif t.text in ("rescue", "catch") and (not ruby or statement_starts(k, code)):
            total += 1 + len(ends)
        elif not ruby and t.text in ("for", "while"):
            # their block is that of the ``do`` behind them
            last = next((b for a, b in sorted(spans.items()) if a > k and code[a].text == "do"), None)
            total += 1 + len(ends)
            if last is not None:
                ends.append(last)
    return total


def indent_of(text: str, t: Token) -> int:
    line = text[text.rfind("\n", 0, t.start) + 1 : t.start]
    return len((line + "x").expandtabs(8)) - 1 - len(line.strip()) if not line.strip() else -1


def indented_cost(some: list[Token], s: Syntax, text: str) -> int:
    """Forks of a body whose blocks are told by their indentation."""
    code = [t for t in some if t.kind not in (COMMENT, NEWLINE)]
    total, around = logic_cost(code, s), []
    for t in code:
        own = indent_of(text, t)
        if own >= 0:
            # the first word of a line: forks that are not less indented have ended, unless it continues one
            while around and (around[-1] > own or (around[-1] == own and t.text not in s.chains and t.text not in ("else", "finally"))):
                around.pop()
        if t.kind != NAME:
            continue
        if t.text in s.chains:
            total += 1
        elif t.text in s.forks:
            if own >= 0:
                total += 1 + len(around)
                around.append(own)
            elif t.text == "if":
                # within an expression
                total += 1 + len(around)
    return total


def doc_above(lines: list[str], start: int, marks: tuple[str, ...]) -> str | None:
    """The comment that stands directly above a line."""
    out, k = [], start - 2
    while k >= 0 and (x := lines[k].strip()) and (x.startswith(marks) or x.startswith(("/*", "*")) or x.endswith("*/")):
        out.append(re.sub(r"^(?:///?!?|//!|#+|--+|/\*+|\*+/?)\s?|\s*\*/$", "", x))
        k -= 1
    while k >= 0 and lines[k].strip().startswith(("@", "#[")):
        k -= 1
    return "\n".join(reversed(out)).strip() or None


def close_of(code: list[Token], k: int) -> int:
    """The place of the sign that closes the one at k; the end if none does."""
    pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, 0
    a, b = code[k].text, pairs[code[k].text]
    for j in range(k, len(code)):
        depth += (code[j].text == a) - (code[j].text == b)
        if not depth:
            return j
    return len(code) - 1


def head_name(head: list[Token], s: Syntax) -> tuple[Token, str | None] | None:
    """The name of the function that a head before a brace opens, and the owner that it names itself."""
    # parentheses count as one sign
    flat: list[Token] = []
    groups: dict[int, list[Token]] = {}
    k = 0
    while k < len(head):
        if head[k].text in ("(", "["):
            j = close_of(head, k)
            groups[len(flat)] = head[k + 1 : j]
            flat.append(Token(SIGN, head[k].text, head[k].start, head[k].line))
            k = j + 1
        else:
            flat.append(head[k])
            k += 1
    texts = [t.text for t in flat]
    for i, t in enumerate(flat):
        if t.kind == NAME and t.text in s.heads:
            owner, j = None, i + 1
            if j < len(flat) and texts[j] == "(":
                # a receiver before the name
                names = [x.text for x in groups[j] if x.kind == NAME]
                if j + 1 < len(flat) and flat[j + 1].kind == NAME:
                    owner, j = (names[-1] if names else None), j + 1
            if t.text in ("init", "constructor") and (j >= len(flat) or flat[j].kind != NAME):
                return t, None
            while j + 2 < len(flat) and flat[j].kind == NAME and texts[j + 1] in (".", "::", ":") and flat[j + 2].kind == NAME:
                owner, j = texts[j], j + 2
            if j < len(flat) and flat[j].kind == NAME and flat[j].text not in s.heads:
                return flat[j], owner
            # without a name of its own it has that of what it is given to
            for b in range(i - 1, 0, -1):
                if texts[b] in ("=", ":", "<-", "-") and flat[b - 1].kind == NAME:
                    return flat[b - 1], None
                if texts[b] == "-" and texts[b - 1] == "<" and b > 1 and flat[b - 2].kind == NAME:
                    return flat[b - 2], None
            return None
    if s.arrows and texts and texts[-1] == "=>":
        for b in range(len(texts) - 1, 0, -1):
            if texts[b] in ("=", ":") and flat[b - 1].kind == NAME and texts[b] == "=":
                return flat[b - 1], None
        named = [b for b in range(1, len(texts)) if texts[b] == "=" and flat[b - 1].kind == NAME]
        return (flat[named[0] - 1], None) if named else None
    if not s.bare or not flat or flat[0].text in s.no_names - s.heads - words("new"):
        return None
    for i in range(1, len(flat)):
        if texts[i] == "(" and flat[i - 1].kind == NAME:
            name = flat[i - 1]
            if name.text in s.no_names or "=" in texts[:i] or "." in texts[i - 2 : i - 1] or "->" in texts[:i] or "new" in texts[:i] or "@" in texts[i - 2 : i - 1]:
                if "@" in texts[i - 2 : i - 1]:
                    continue  # what annotates the function
                return None
            owner = texts[i - 3] if i > 2 and texts[i - 2] == "::" else None
            return name, owner
    return None


def statement(head: list[Token], s: Syntax) -> list[Token]:
    """The last statement of what stands before a brace, without lines for the preprocessor."""
    out, depth, line = [], 0, 0
    for k, t in enumerate(head):
        if t.text == "#" and not depth and (k == 0 or head[k - 1].line < t.line) and not (k + 1 < len(head) and head[k + 1].text in ("[", "!")):
            line = t.line
        if t.line == line:
            continue
        if s.lines and out and not depth and t.line > out[-1].line and t.text not in (")", "]", ".", ":", "->", "where", "=>", "throws") and out[-1].text not in (",", "=", "(", ":", "=>", "->", "."):
            out = []
        depth += (t.kind == SIGN) * ((t.text in OPEN) - (t.text in CLOSED))
        out.append(t)
    return out or head[-1:]


def first_of(head: list[Token], name: Token, s: Syntax) -> Token:
    """Where a function begins: with its statement, or with the line of its word where it has one."""
    word = next((t for t in head if t.kind == NAME and t.text in s.heads), None)
    return next(t for t in head if t.line == (word or name).line) if word else head[0]


def owner_name(head: list[Token], s: Syntax) -> str | None:
    """The name of the type that a head before a brace opens."""
    for i, t in enumerate(head):
        if t.kind == NAME and t.text in s.owners and (i == 0 or head[i - 1].text not in (".", "(")):
            rest = head[i + 1 :]
            if t.text in ("struct", "interface") and i and head[i - 1].kind == NAME and (not rest or rest[0].kind != NAME):
                return head[i - 1].text  # type Name struct
            at = next((k for k, x in enumerate(rest) if x.text == "for"), None) if t.text == "impl" else None
            rest = rest[at + 1 :] if at is not None else rest
            if rest and rest[0].text == "<":
                rest = rest[close_of(rest, 0) + 1 :]
            return next((x.text for x in rest if x.kind == NAME and x.text not in ("class", "case", "companion")), None)
    return None


def braced(text: str, some: list[Token], s: Syntax) -> Iterator[tuple[Token, Token, str | None, int, int]]:
    """(first token, name, owner, place of the body, last place) of the functions of a text with braces; places in the code."""
    code = [t for t in some if t.kind not in (COMMENT, NEWLINE)]
    stack: list[tuple[tuple | None, str | None]] = []
    depth, start = 0, 0
    saved: list[int] = []
    for k, t in enumerate(code):
        if t.kind == STRING:
            continue
        if t.text in ("(", "["):
            depth += 1
        elif t.text in CLOSED:
            depth = max(0, depth - 1)
        elif t.text == "{":
            head = statement(code[start:k], s)
            owner = owner_name(head, s)
            # a function within parentheses is an argument and has no name
            found = None if depth or (owner and not any(h.text in s.heads for h in head)) else head_name(head, s)
            if found:
                stack.append(((first_of(head, found[0], s), found[0], found[1] or next((o for _, o in reversed(stack) if o), None), k), None))
            else:
                stack.append((None, owner))
            saved.append(depth)
            depth, start = 0, k + 1
        elif t.text == "}":
            if stack:
                made, _ = stack.pop()
                depth = saved.pop()
                if made:
                    yield *made, k
            start = k + 1 if not depth else start
        elif t.text == ";" and not depth:
            start = k + 1


def functions(text: str, lang: str) -> list[dict]:
    """The functions of a text in source order; an unfinished one is left out."""
    s = SYNTAX[lang]
    some = tokens(text, lang)
    code = [t for t in some if t.kind not in (COMMENT, NEWLINE)]
    lines = text.split("\n")
    keywords = s.no_names | s.owners | s.openers | words("else end true false null nil none None let const var static return self this")
    ruby = lang == "ruby"
    found: list[tuple[int, int, int, str, str | None, int]] = []  # first and last place in code, body, name, owner, place of the name
    place = {t.start: k for k, t in enumerate(code)}
    if s.close == "brace":
        for first, name, owner, body, last in braced(text, some, s):
            # what stands before the head on lines of its own (annotations) is no part of it
            found.append((place[first.start], last, body, name.text, owner, name.start))
    elif s.close == "end":
        with_ends = [t for t in some if t.kind != COMMENT]
        blocks = sorted(keyword_blocks(with_ends, s, ruby))
        for a, b, word in blocks:
            if word not in s.heads:
                continue
            j = a + 1
            parts = []
            while j < b and with_ends[j].kind == NAME or with_ends[j].text in (".", ":"):
                if with_ends[j].kind == NAME:
                    parts.append(with_ends[j])
                    if with_ends[j + 1].text not in (".", ":"):
                        break
                j += 1
            if not parts and a > 1 and with_ends[a - 1].text == "=" and with_ends[a - 2].kind == NAME:
                parts = [with_ends[a - 2]]
            if not parts:
                continue
            around = [with_ends[x + 1].text for x, y, w in blocks if x < a and y > b and w in s.owners and with_ends[x + 1].kind == NAME]
            owner = parts[-2].text if len(parts) > 1 and parts[-2].text != "self" else around[-1] if around else None
            found.append((place[with_ends[a].start], place[with_ends[b].start], place[with_ends[a].start] + 1, parts[-1].text, owner, parts[-1].start))
    else:
        owners: list[tuple[int, str]] = []
        for k, t in enumerate(code):
            own = indent_of(text, t)
            if own >= 0:
                while owners and owners[-1][0] >= own:
                    owners.pop()
            follows = code[k + 1] if k + 1 < len(code) else None
            if t.kind != NAME or not follows or follows.kind != NAME:
                continue
            if t.text in s.owners and own >= 0:
                owners.append((own, follows.text))
            elif t.text in s.heads:
                line = lines[t.line - 1]
                deep = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
                last = k
                while last + 1 < len(code) and ((x := indent_of(text, code[last + 1])) < 0 or x > deep):
                    last += 1
                body = next((j for j in range(k, last + 1) if code[j].text == ":" and j + 1 <= last and code[j + 1].line > code[j].line), k + 1)
                found.append((k, last, body, follows.text, owners[-1][1] if owners else None, follows.start))
    named = {f[5] for f in found}
    out = []
    for first, last, body, name, owner, at in sorted(found):
        a, b = code[first], code[last]
        start, end = a.line, b.line + b.text.count("\n")
        inside = [t for t in some if a.start <= t.start <= b.start]
        within = code[body : last + 1]
        cost = braced_cost(within, s, text) if s.close == "brace" else worded_cost([t for t in inside if t.start > at], s, ruby) if s.close == "end" else indented_cost([t for t in inside if t.start > at], s, text)
        private = name.startswith("_") or any(x.text == "private" for x in code[first:body])
        exported = name[:1].isupper() if lang == "go" else any(x.text == "pub" for x in code[first:body]) if lang == "rust" else not private
        out.append({
            "name": name, "owner": owner, "signature": lines[start - 1].strip(), "body": "\n".join(lines[start - 1 : end]), "doc": doc_above(lines, start, s.line), "start_line": start, "end_line": end,
            "ncloc": len(code_lines(inside)), "cognitive": cost, "calls": calls_of(within, s, named), "locals": [f[3] for f in sorted(found) if first < f[0] and f[1] <= last and f[5] != at], "exported": exported, "shape": shape(within, keywords),
        })
    return out
