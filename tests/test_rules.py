import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolith.plans import rules as R


def test_catalogue():
    live = R.catalogue()
    assert len(live) == 25 and len({r.id for r in live}) == 25
    assert str(live[0]) == "func: loc >= 200 and tangle >= 0.25 and read < 1" and live[0].calibrated == 0
    assert next(r for r in live if r.id == "fossil-trap").clauses[1].field == "trap"
    assert all(R.parse(str(r)).clauses == r.clauses for r in live)
    assert len(R.FIELDS) == 26 and len(R.OFFERED) == 25 and "trap" not in R.OFFERED


@pytest.mark.parametrize("text", ["loc >= 1", "dir: loc >= 1", "func: loc >= x", "func: loc = 1", "func: nothing >= 1", "func: loc >= 1  and  ", "func: loc >= 1 or loc < 2", "func: loc>=1", "func: " + " and ".join(["loc >= 1"] * 5)])
def test_parse_errors(text):
    with pytest.raises(ValueError):
        R.parse(text)


def test_parse_aliases_and_cap():
    assert R.parse("function: lines >= 1 and legible < 0.5").clauses[1].field == "illegible"
    # clauses about the file or repository do not count
    assert len(R.parse("func: " + " and ".join(["loc >= 1"] * 4 + ["file_loc >= 2", "repo_age >= 3"])).clauses) == 6


def test_edits():
    ok = R.Rule("func", (R.Clause("loc", ">=", 3),), title="t")
    assert R.check_edit(ok) is None
    assert R.check_edit(R.Rule("func", ok.clauses, title=" ")) and R.check_edit(R.Rule("func", (), title="t"))
    assert R.check_edit(R.Rule("file", (R.Clause("callers", ">=", 1),), title="t"))
    assert R.check_edit(R.Rule("func", (R.Clause("loc", ">=", 0),), title="t"))
    assert R.check_edit(R.Rule("func", (R.Clause("read", ">=", 0), R.Clause("repo_age", ">=", 0)), title="t")) is None


def test_amendments_round_trip():
    live = R.catalogue()
    new = R.Amendment(live[0].id, R.Rule("func", (R.Clause("loc", ">=", 300), *live[0].clauses[1:]), id=live[0].id, title=live[0].id))
    own = R.Amendment("mine", R.Rule("file", (R.Clause("funcs", ">", 3), R.Clause("loc", "<", 9)), id="mine", title="My own", calibrated=1))
    off = R.Amendment(live[1].id, off=True)
    other = R.Amendment(live[2].id, R.Rule("file", (R.Clause("loc", ">=", 1),), id=live[2].id))
    back = [R.parse_line(R.format_line(a)) for a in (new, own, off)]
    assert back[0].rule.clauses == new.rule.clauses and back[1].rule.calibrated == 1 and back[1].rule.title == "My own" and back[2].off
    rules, gone = R.amended(live, [*back, other])
    assert rules[0].clauses[0].value == 300 and [r.id for r in gone] == [live[1].id] and rules[-1].id == "mine"
    assert next(r for r in rules if r.id == live[2].id).clauses == live[2].clauses
    assert R.parse_line("plain text") is None and R.parse_line("- `x` `func: what >= 1`") is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(list(R.FIELDS)), st.sampled_from(R.OPS), st.integers(0, 500) | st.sampled_from([0.25, 0.6, 0.9])), min_size=1, max_size=4), st.sampled_from(["func", "file"]))
def test_text_round_trip(clauses, pop):
    rule = R.Rule(pop, tuple(R.Clause(f, o, float(v)) for f, o, v in clauses))
    assert R.parse(str(rule)).clauses == rule.clauses


def test_tighten_and_ids():
    r = R.parse("func: loc >= 200 and tangle >= 0.25")
    assert R.tightened(r, 240.6).clauses[0].value == 241 and R.tightened(r, 100).clauses[0].value == 200 and R.tightened(r, None) is r
    assert R.mint_id("Big  Körper!", set()) == "big-k-rper" and R.mint_id("a", {"a", "a-2"}) == "a-3"
    s = R.Sentence("{{name}} has {{loc}} lines", "long")
    assert s.render({"name": "f", "loc": 3}) == "f has 3 lines" and s.render({"name": "f", "loc": None}) == "long"
    assert R.Sentence("{{what}}").unknown() == ["what"]
