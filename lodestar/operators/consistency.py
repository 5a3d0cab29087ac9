"""Facts that are both asserted and denied, and what to do about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestar.plans.base import Base
from lodestar.plans.rules import without


def contradictions(base: Base, predicate: str, arity: int) -> DataFrame:
    """The rows that are both positive and negative facts of a predicate."""
    return base.relation((predicate, arity, False)).intersect(base.relation((predicate, arity, True)))


def has_contradiction(base: Base, predicate: str, row: tuple) -> bool:
    from lodestar.plans.rules import atom, denied

    return not base.ask(atom(predicate, *row)).isEmpty() and not base.ask(denied(predicate, *row)).isEmpty()


@dataclass
class Report:
    """Contradictions by predicate, and how many facts there are in all."""

    found: dict[tuple[str, int], DataFrame]
    counts: dict[tuple[str, int], int]
    facts: int

    @property
    def consistent(self) -> bool:
        return not any(self.counts.values())


def check(base: Base) -> Report:
    """Check every predicate that has facts of both signs."""
    both = sorted({(p, n) for p, n, neg in base.relations if neg and (p, n, False) in base.relations})
    found = {key: contradictions(base, *key) for key in both}
    return Report(found, {key: df.count() for key, df in found.items()}, base.facts().count())


KEEP = {"keep_positive": (True,), "keep_negative": (False,), "remove_both": (True, False)}


def enforce(base: Base, strategy: str) -> Base:
    """A base without contradictions: contradicted rows leave the negative side,
    the positive side, or both; nulls are equal."""
    if strategy not in KEEP:
        raise ValueError(f"no such strategy: {strategy}")
    out = Base(base.spark, base.relations)
    for p, n, neg in base.relations:
        if neg and (p, n, False) in base.relations:
            bad = contradictions(base, p, n)
            for sign in KEEP[strategy]:
                rows = base.relations[p, n, sign]
                out.relations[p, n, sign] = without(rows, bad)
    return out
