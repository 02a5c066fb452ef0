"""``Repo``: the engine's operators over one repository's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions import measures
from .operators import findings, graph, readings, replay, rollup
from .plans import facts as plan
from .plans.rules import TARGET, Amendment, Rule, amended, catalogue, parse


class Repo:
    """A repository read into ``plans.facts.Tables``; facts are built once and kept for the session."""

    def __init__(self, tables: plan.Tables, saved: list[Amendment] | None = None, decisions: DataFrame | None = None):
        self.tables, self.decisions = tables, decisions
        self.rules, self.off = amended(catalogue(), saved or [])
        self._facts: DataFrame | None = None

    def facts(self) -> DataFrame:
        if self._facts is None:
            self._facts = plan.build(self.tables).persist()
        return self._facts

    def close(self) -> None:
        if self._facts is not None:
            self._facts.unpersist()
            self._facts = None

    def rule(self, text: str) -> DataFrame:
        return findings.hits(self.facts(), [parse(text)])

    def report(self, rules: list[Rule] | None = None) -> DataFrame:
        return findings.report(self.facts(), rules or self.rules, self.decisions)

    def spread(self, *fields: str) -> DataFrame:
        return findings.spreads(self.facts(), list(fields))

    def calibrate(self, target: int = TARGET) -> DataFrame:
        return findings.calibrate(self.facts(), self.rules, target)

    def balance(self, target: int) -> list[findings.BalanceRow]:
        return findings.balance(self.facts(), self.rules, target, self.decisions)

    def rules_view(self) -> DataFrame:
        return findings.rules_view(self.facts(), self.rules)

    def blocked(self, traced: findings.Traced) -> list[dict[str, str]]:
        return findings.blocked(self.facts(), self.rules, traced)

    def merge(self) -> DataFrame:
        return findings.merge_findings(findings.hits(self.facts(), self.rules))

    def histogram(self, lens: str, field: str, by_dir: bool = False) -> DataFrame:
        f = self.facts().where("kind = 'func'")
        x = f[field]
        return rollup.histogram(f, measures.lens_band(lens, x), x, by_dir)

    def search(self, query: str, limit: int = 40) -> DataFrame:
        return readings.search(self.facts().select("kind", "name", "path", "line", "loc"), query, limit)

    def callers(self, node: object) -> DataFrame:
        return graph.callers_by_file(self.tables.edges, self.tables.nodes, node)

    def as_of(self, deltas: DataFrame, idx: int) -> DataFrame:
        return replay.as_of(deltas, idx)

    def verify(self, subjects: DataFrame, read: DataFrame) -> DataFrame:
        return readings.verify(subjects, read)

    def queue(self, tasks: DataFrame, n: int = 10) -> DataFrame:
        return readings.round_robin(tasks, n)
