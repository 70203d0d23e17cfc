"""Yes-or-no rules over named views of a text, written once and rendered as column expressions or as SQL.

A view is a form of a text (say its normalised title); a rule asks whether a view holds a pattern, or combines rules.
Views are computed once a row: ``decide`` binds them to the fields of a struct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule:
    def __and__(self, other: Rule) -> Rule:
        return Joined("AND", (self, other))

    def __or__(self, other: Rule) -> Rule:
        return Joined("OR", (self, other))

    def __invert__(self) -> Rule:
        return Not(self)

    def column(self, view: Callable[[str], Column]) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Holds(Rule):
    """The view holds a match of the pattern."""

    view: str
    pattern: str

    def column(self, view):
        return view(self.view).rlike(self.pattern)

    def sql(self):
        # RE2 has no lookahead; where only presence is asked, a group does the same
        return f"regexp_matches({self.view}, '{self.pattern.replace('(?=', '(?:')}')"


def says(view: str, phrases: tuple[str, ...]) -> Rule:
    """The view holds one of some phrases of letters and spaces."""
    return Holds(view, "|".join(phrases))


@dataclass(frozen=True)
class Joined(Rule):
    how: str
    rules: tuple[Rule, ...]

    def column(self, view):
        first, *rest = (r.column(view) for r in self.rules)
        for r in rest:
            first = first & r if self.how == "AND" else first | r
        return first

    def sql(self):
        return "(" + f" {self.how} ".join(r.sql() for r in self.rules) + ")"


@dataclass(frozen=True)
class Not(Rule):
    rule: Rule

    def column(self, view):
        return ~self.rule.column(view)

    def sql(self):
        return f"NOT {self.rule.sql()}"


@dataclass(frozen=True)
class AtLeast(Rule):
    """So many of the rules hold."""

    n: int
    rules: tuple[Rule, ...]

    def column(self, view):
        return sum((r.column(view).cast("int") for r in self.rules), F.lit(0)) >= self.n

    def sql(self):
        return "(" + " + ".join(f"{r.sql()}::INT" for r in self.rules) + f") >= {self.n}"


def decide(views: dict[str, Column], verdict: Callable[[Callable[[str], Column]], Column]) -> Column:
    """verdict over views that are computed once: inlined, long rule lists repeat them and outgrow generated code."""
    bound = F.transform(F.array(F.struct(*[c.alias(k) for k, c in views.items()])), lambda s: verdict(lambda k: s[k]))
    return F.get(bound, 0)


def first_kind(rules: list[tuple[Rule, str]], default: str | None, view: Callable[[str], Column]) -> Column:
    """The kind of the first rule that holds."""
    (rule, kind), *rest = rules
    out = F.when(rule.column(view), kind)
    for rule, kind in rest:
        out = out.when(rule.column(view), kind)
    return out.otherwise(default)


def first_kind_sql(rules: list[tuple[Rule, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{k}'" for r, k in rules) + f" ELSE '{default}' END"
