"""The rule language: ``func: loc >= 200 and illegible >= 0.6``.

A rule is a population and a conjunction of thresholds over the fields of the facts table. This module is
plain Python: text to rules and back, the catalogue, saved amendments, edit checks and sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: Fixed values of the language: field -> (aliases, scope, population it is offered for, graded, needs a reading).
FIELDS: dict[str, tuple[tuple[str, ...], str, str | None, bool, bool]] = {
    "loc": (("lines",), "subject", None, False, False),
    "ncloc": ((), "subject", None, False, False),
    "funcs": ((), "subject", "file", False, False),
    "callers": ((), "subject", "func", False, False),
    "calls": (("reach",), "subject", "func", False, False),
    "clone_count": (("clone_size", "clones"), "subject", "func", False, False),
    "cognitive": ((), "subject", None, False, False),
    "tangle": (("complexity",), "subject", None, True, False),
    "age": (("age_days",), "subject", None, False, False),
    "touched": (("touched_days",), "subject", None, False, False),
    "commits": (("churn",), "subject", None, False, False),
    "read": ((), "subject", None, False, False),
    "surprise": ((), "subject", None, True, True),
    "doc_relevant": (("documented", "docs"), "subject", None, True, True),
    "doc_present": (("has_doc", "doc"), "subject", None, False, False),
    "under_test": ((), "subject", "func", False, False),
    "dependents": ((), "subject", "func", False, False),
    "header": ((), "subject", "func", False, False),
    "illegible": (("legible",), "subject", "func", True, True),
    "headcount": (("hands",), "subject", None, False, False),
    "file_loc": (("file_lines",), "file", "func", False, False),
    "file_funcs": ((), "file", "func", False, False),
    "file_headcount": ((), "file", "func", False, False),
    "repo_headcount": ((), "repo", None, False, False),
    "repo_age": ((), "repo", None, False, False),
    "trap": (("traps",), "subject", "func", False, True),
}
FIELD_OF = {name: f for f, (aliases, *_) in FIELDS.items() for name in (f, *aliases)}
#: What a picker offers: all but ``trap``, which parses all the same.
OFFERED = [f for f in FIELDS if f != "trap"]
OPS = (">=", ">", "<=", "<")
MOST_CLAUSES = 4
TARGET = 8
MOST_HITS = 50


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: float

    @property
    def scope(self) -> str:
        return FIELDS[self.field][1]

    @property
    def graded(self) -> bool:
        return FIELDS[self.field][3]

    @property
    def needs_reading(self) -> bool:
        return FIELDS[self.field][4]

    def opens_up(self) -> bool:
        return self.op in (">=", ">")

    def __str__(self) -> str:
        return f"{self.field} {self.op} {number(self.value)}"


@dataclass(frozen=True)
class Rule:
    pop: str
    clauses: tuple[Clause, ...]
    id: str = "ad-hoc"
    title: str = "ad-hoc"
    says: str = ""
    so_what: str = ""
    calibrated: int = 0

    def __str__(self) -> str:
        return f"{self.pop}: " + " and ".join(map(str, self.clauses))

    @property
    def shape(self) -> tuple[tuple[str, str], ...]:
        return tuple((c.field, c.op) for c in self.clauses)

    def at(self, value: float) -> Rule:
        """The rule with another threshold in its calibrated clause."""
        clauses = list(self.clauses)
        clauses[self.calibrated] = replace(clauses[self.calibrated], value=value)
        return replace(self, clauses=tuple(clauses))

    def without_calibrated(self) -> Rule:
        return replace(self, clauses=tuple(c for k, c in enumerate(self.clauses) if k != self.calibrated))


def number(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(value)


def parse(text: str) -> Rule:
    """Reads a rule. Clauses are joined by ``and`` between single spaces; ValueError says what is wrong."""
    pop, colon, rest = text.partition(":")
    if not colon:
        raise ValueError("a rule begins with `func:` or `file:`")
    kinds = {"func": "func", "function": "func", "file": "file"}
    if pop.strip() not in kinds:
        raise ValueError(f"`{pop.strip()}` is no population; use func or file")
    clauses = []
    for part in rest.split(" and "):
        words = part.split()
        if len(words) != 3:
            raise ValueError(f"`{part.strip()}` is not `field op number`")
        name, op, value = words
        if name not in FIELD_OF:
            raise ValueError(f"`{name}` is no field")
        if op not in OPS:
            raise ValueError(f"`{op}` is no operator")
        try:
            clauses.append(Clause(FIELD_OF[name], op, float(value)))
        except ValueError:
            raise ValueError(f"`{value}` is no number") from None
    if sum(c.scope == "subject" for c in clauses) > MOST_CLAUSES:
        raise ValueError(f"a rule has at most {MOST_CLAUSES} clauses about its subject")
    return Rule(kinds[pop.strip()], tuple(clauses))


#: The shipped rules. ``*`` marks the clause that calibration moves.
SHIPPED = """
giant-function | func: *loc >= 200 and tangle >= 0.25 and read < 1
giant-illegible | func: *loc >= 200 and illegible >= 0.6
crowded-file | file: *funcs >= 40 and doc_present < 1 and read < 1
crowded-unpredictable | file: *funcs >= 40 and surprise >= 0.6
load-bearing-unread | func: *dependents >= 20 and read < 1 and ncloc >= 10
knotty-load-bearing | func: tangle >= 0.8 and *dependents >= 10 and ncloc >= 10
load-bearing-illegible | func: illegible >= 0.6 and *dependents >= 10 and ncloc >= 10
load-bearing-undocumented | func: doc_present < 1 and *dependents >= 10 and ncloc >= 10
undocumented-declaration | func: header >= 1 and *doc_present < 1 and dependents >= 10 and ncloc < 10
load-bearing-untested | func: under_test < 1 and surprise >= 0.6 and *dependents >= 10 and ncloc >= 10
surprising-changing | func: surprise >= 0.6 and *commits >= 4 and ncloc >= 10
surprising-far-reaching | func: surprise >= 0.6 and *calls >= 10 and ncloc >= 10
stale-doc | func: doc_relevant >= 0.7 and *surprise >= 0.9 and ncloc >= 10
trap-being-edited | func: trap >= 1 and *commits >= 3 and ncloc >= 10
fossil-trap | func: repo_age >= 730 and *trap >= 1 and touched >= 1095 and ncloc >= 10
clone-being-edited | func: clone_count >= 3 and *commits >= 2 and ncloc >= 10
widely-cloned | func: clone_count >= 4 and *ncloc >= 30
fossil | func: repo_age >= 1095 and *touched >= 1825 and ncloc >= 100
tangled-for-size | func: tangle >= 0.8 and *ncloc >= 40 and read < 1
tangled-illegible | func: tangle >= 0.8 and illegible >= 0.6 and *ncloc >= 40
sole-author | func: repo_headcount >= 4 and headcount <= 1 and *dependents >= 10 and ncloc >= 10
sole-author-coordinator | func: repo_headcount >= 4 and headcount <= 1 and *calls >= 10 and ncloc >= 10
alone-in-shared-code | func: file_headcount >= 6 and headcount <= 1 and *ncloc >= 20
lone-file | file: repo_headcount >= 6 and *funcs >= 5 and headcount <= 2
crowded-and-knotty | func: *headcount >= 4 and tangle >= 0.8 and ncloc >= 10
"""


def catalogue() -> list[Rule]:
    """The shipped rules, in their order."""
    out = []
    for line in SHIPPED.strip().splitlines():
        rule_id, _, text = line.partition(" | ")
        clauses = text.partition(":")[2].split(" and ")
        at = next(k for k, c in enumerate(clauses) if "*" in c)
        out.append(replace(parse(text.replace("*", "")), id=rule_id, title=rule_id.replace("-", " "), so_what=f"Found by {rule_id}.", says="{{name}} in {{path}}: " + clauses[at].replace("*", "").split()[0] + " is {{" + clauses[at].replace("*", "").split()[0] + "}}", calibrated=at))
    return out


def mint_id(title: str, taken: set[str]) -> str:
    """A new id from a title: lower case, other characters to single hyphens, a number where it is taken."""
    base = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "rule"
    n, out = 2, base
    while out in taken:
        out, n = f"{base}-{n}", n + 1
    return out


def check_edit(rule: Rule) -> str | None:
    """Why a rule may not be saved, or None: it needs a title, fields of its population, and clauses that can fail."""
    if not rule.title.strip():
        return "a rule needs a title"
    if not rule.clauses:
        return "a rule needs a clause"
    for c in rule.clauses:
        offered = FIELDS[c.field][2]
        if offered and offered != rule.pop:
            return f"{c.field} is a field of {offered} rules"
        if c.scope == "repo" or c.field == "read":
            continue
        if (c.op == ">=" and c.value <= 0) or (c.op == ">" and c.value < 0) or (c.op == "<" and c.value <= 0) or (c.op == "<=" and c.value < 0):
            return f"`{c}` holds always or never"
        if c.graded and ((c.op in (">=", ">") and c.value > 1) or (c.op == "<=" and c.value >= 1) or (c.op == "<" and c.value > 1)):
            return f"`{c}` holds always or never"
    return None


@dataclass(frozen=True)
class Amendment:
    """A saved line: an override of a shipped rule, a shipped rule switched off, or a rule of one's own."""

    id: str
    rule: Rule | None = None
    off: bool = False
    was: tuple[tuple[str, str], ...] | None = None


LINE = re.compile(r"^- `(?P<id>[a-z0-9-]+)`(?: (?P<off>off))?(?: `(?P<text>[^`]*)`)?(?: was `(?P<was>[^`]*)`)?(?: — (?P<title>.*))?$")


def parse_line(line: str) -> Amendment | None:
    """One line of the saved catalogue, or None for any other text. Unknown rule text is skipped, not an error."""
    m = LINE.match(line.strip())
    if not m or not (m["off"] or m["text"]):
        return None
    try:
        marked = m["text"] and m["text"].replace("*", "")
        rule = replace(parse(marked), id=m["id"], title=m["title"] or m["id"]) if marked else None
        if rule and "*" in m["text"]:
            rule = replace(rule, calibrated=next(k for k, c in enumerate(m["text"].partition(":")[2].split(" and ")) if "*" in c))
        was = parse(m["was"].replace("*", "")).shape if m["was"] else None
    except ValueError:
        return None
    return Amendment(m["id"], rule, bool(m["off"]), was)


def format_line(a: Amendment) -> str:
    """What ``parse_line`` reads back."""
    parts = [f"- `{a.id}`"]
    if a.off:
        parts.append("off")
    if a.rule:
        clauses = " and ".join(("*" if k == a.rule.calibrated else "") + str(c) for k, c in enumerate(a.rule.clauses))
        parts.append(f"`{a.rule.pop}: {clauses}`")
        if a.rule.title != a.id:
            parts.append(f"— {a.rule.title}")
    return " ".join(parts)


def amended(shipped: list[Rule], saved: list[Amendment]) -> tuple[list[Rule], list[Rule]]:
    """The rules in force and those switched off: overrides in place, own rules behind.

    An override whose fields and operators are not those of the shipped rule (or of what it says it
    overrode) was written for another rule and is dropped. Of several lines for one id the last holds.
    """
    by_id = {a.id: a for a in saved}
    live, off = [], []
    for r in shipped:
        a = by_id.pop(r.id, None)
        if a and a.rule and (a.was or a.rule.shape) == r.shape:
            r = replace(r, clauses=a.rule.clauses)
        (off if a and a.off else live).append(r)
    live += [a.rule for a in by_id.values() if a.rule and not a.off]
    return live, off


def tightened(rule: Rule, value: float | None) -> Rule:
    """The rule moved to a suggested threshold if that is tighter; graded fields keep two decimals, others none."""
    if value is None or rule.calibrated >= len(rule.clauses):
        return rule
    c = rule.clauses[rule.calibrated]
    # halves go away from zero
    scale = 100 if c.graded else 1
    value = int(abs(value) * scale + 0.5) / scale * (1 if value >= 0 else -1)
    return rule.at(value) if (value > c.value if c.opens_up() else value < c.value) else rule


@dataclass
class Sentence:
    """A template with ``{{tokens}}``; without all of its tokens it is the fallback."""

    text: str
    fallback: str = ""
    tokens: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tokens = re.findall(r"\{\{(\w+)\}\}", self.text)

    def unknown(self) -> list[str]:
        return [t for t in self.tokens if t not in FIELDS and t not in ("name", "path", "lang", "window")]

    def render(self, values: dict[str, object]) -> str:
        if not self.text or any(values.get(t) is None for t in self.tokens):
            return self.fallback
        return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]), self.text)
