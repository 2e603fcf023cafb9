"""Building alert rows, and the rule registry.

A rule is a function `DataFrame of events -> DataFrame of ALERT`. Rules that look at one event at
a time are declared as cases (condition, alert), so that all of them share one scan.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.schemas import ALERT

Text = str | Column


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def alert(
    *,
    rule_id: str,
    rule: int,
    technique: str,
    severity: Text,
    log_source: str,
    description: Column,
    first_seen: Text = "ts",
    last_seen: Column | None = None,
    source_ip: Column | None = None,
    username: Column | None = None,
    dedup_key: Column | None = None,
    extra: dict[str, Column] | None = None,
    at: Column | None = None,
    seq: Column | None = None,
) -> Column:
    """One alert as a struct in ALERT shape."""
    first = F.col(first_seen) if isinstance(first_seen, str) else first_seen
    pairs = [p for k, v in (extra or {}).items() for p in (F.lit(k), v.cast("string"))]
    values = {
        "rule_id": F.lit(rule_id),
        "technique": F.lit(technique),
        "severity": _column(severity),
        "timestamp": F.current_timestamp(),
        "first_seen": first,
        "last_seen": _column(last_seen),
        "source_ip": _column(source_ip),
        "username": _column(username),
        "description": description,
        "log_source": F.lit(log_source),
        "dedup_key": _column(dedup_key),
        "extra": F.create_map(*pairs),
        "ord": F.struct(
            F.lit(0).cast("bigint").alias("run"),
            F.lit(rule).alias("rule"),
            (F.lit(0) if at is None else at).cast("bigint").alias("at"),
            (F.col("seq") if seq is None else seq).cast("bigint").alias("seq"),
        ),
    }
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ALERT]
    )


@dataclass(frozen=True)
class Case:
    when: Column
    alert: Column


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def alerts_from_cases(events: DataFrame, cases: list[Case]) -> DataFrame:
    """All alerts of all cases in one pass over the events.

    The combined condition is a plain filter and reaches the scan; only rows that fire build
    alert structs.
    """
    fired = events.filter(any_of([c.when for c in cases]))
    if len(cases) == 1:
        return fired.select(cases[0].alert.alias("a")).select("a.*")
    found = F.array_compact(F.array(*[F.when(c.when, c.alert) for c in cases]))
    return fired.select(F.explode(found).alias("a")).select("a.*")


@dataclass(frozen=True)
class Rule:
    """`cases` for rules over single events, `detect` for everything else."""

    name: str
    source: str
    order: int
    cases: Callable[[], list[Case]] | None = None
    detect: Callable[..., DataFrame] | None = None
    parameters: dict = field(default_factory=dict)

    def run(self, events: DataFrame, **overrides) -> DataFrame:
        if self.cases is not None:
            return alerts_from_cases(events, self.cases())
        return self.detect(events, **{**self.parameters, **overrides})


class RuleBook:
    """Rules by name. Every registered rule must return the alert shape."""

    def __init__(self, rules: list[Rule] = ()):
        self.rules: dict[str, Rule] = {}
        for rule in rules:
            self.rules[rule.name] = rule

    def register(self, rule: Rule, sample: DataFrame) -> "RuleBook":
        """Add a rule after checking its output columns on the plan of `sample`."""
        produced = rule.run(sample).schema
        got = [(f.name, f.dataType) for f in produced]
        want = [(f.name, f.dataType) for f in ALERT]
        if got != want:
            raise ValueError(f"rule {rule.name} does not return the alert columns: {got}")
        book = RuleBook()
        book.rules = {**self.rules, rule.name: rule}
        return book

    def for_source(self, source: str) -> list[Rule]:
        return sorted((r for r in self.rules.values() if r.source == source), key=lambda r: r.order)

    def run_source(self, source: str, events: DataFrame, **overrides) -> DataFrame:
        """Every rule of one source; single-event rules share one scan.

        `overrides` maps a rule name to its parameters.
        """
        rules = self.for_source(source)
        cases = [case for r in rules if r.cases is not None for case in r.cases()]
        outputs = [alerts_from_cases(events, cases)] if cases else []
        outputs += [r.run(events, **overrides.get(r.name, {})) for r in rules if r.cases is None]
        return union_all(outputs)

    def run(self, tables: dict[str, DataFrame], **overrides) -> DataFrame:
        """Every rule over every source table given."""
        return union_all(
            [self.run_source(s, t, **overrides) for s, t in tables.items() if self.for_source(s)]
        )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
