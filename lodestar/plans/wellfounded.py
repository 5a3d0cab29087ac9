"""Well-founded models of rules whose absence lies on a cycle, by an alternating fixpoint.

Rows are true, undefined or neither. With absence read off a fixed relation, rules are
positive and have a least model. Read off too few rows, absence holds too often and the model
is an overestimate; read off an overestimate, it is an underestimate. The two are computed in
turn until the underestimate grows no more: it is what is true, and what the overestimate has
besides is undefined. The underestimate only grows, so each turn goes on from the last one.

Only predicates that depend on such a cycle are treated so, group by group; others are
derived as ever. What is undefined below is possible but not true above.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from lodestar.plans.rules import Atom, Rule, without
from lodestar.plans.strata import Key, groups
from lodestar.sources.tables import Parts, settle

if TYPE_CHECKING:
    from lodestar.plans.base import Base


@dataclass
class Model:
    """``base`` holds what is true, ``undefined`` the rows that are neither true nor false."""

    base: Base
    undefined: dict[Key, DataFrame] = field(default_factory=dict)
    turns: int = 0
    per_round: list[int] = field(default_factory=list)
    fixpoint: bool = True


def _of(a: Atom) -> Key:
    return (a.predicate, len(a.args), False) if a.absent else a.key


def _settled(rules: list[Rule], name: str) -> list[Rule]:
    """The rules with every absent atom asking a relation of another name, which doesn't change."""

    def other(a: Atom) -> Atom:
        return replace(a, predicate=f"{name} {a.predicate}") if a.absent else a

    return [replace(r, body=tuple(map(other, r.body))) for r in rules]


def well_founded(base: Base, rules: list[Rule], max_rounds: int | None = None) -> Model:
    """The well-founded model; where strata exist, it is theirs and nothing is undefined.

    ``max_rounds`` bounds the rounds of each least model; one that it cuts makes the result unsure,
    which ``fixpoint`` tells.
    """
    model = Model(type(base)(base.spark, base.relations, base.trace))
    for own in groups(rules):
        heads = {r.head.key for r in own}
        asked = {_of(a) for r in own for a in r.body}
        cycle = any(a.absent and _of(a) in heads for r in own for a in r.body)
        if cycle and any(r.aggregates for r in own):
            raise ValueError("a head that sums up can't lie on a cycle")
        if cycle or asked & set(model.undefined):
            _alternate(model, own, heads, max_rounds)
        else:
            run = model.base.derive(own, max_rounds)
            model.base, model.fixpoint = run.base, model.fixpoint and run.fixpoint
            model.per_round += run.per_round
    return model


def _alternate(model: Model, own: list[Rule], heads: set[Key], max_rounds: int | None) -> None:
    true, spark = model.base, model.base.spark

    def possible(key: Key) -> DataFrame:
        rows = true.relation(key)
        return rows.union(model.undefined[key]) if key in model.undefined else rows

    outside = {_of(a) for r in own for a in r.body} - heads
    held: dict[Key, Parts] = {}
    under: dict[Key, DataFrame] = {}
    over: dict[Key, DataFrame] = {}

    def least(rules: list[Rule], low: bool, against: dict[Key, DataFrame]) -> dict[Key, DataFrame]:
        """The heads' rows if absence is read off ``against`` and, outside the group, off the other estimate."""
        start = type(true)(spark, {k: true.relations[k] for k in heads if k in true.relations})
        for key in outside:
            if key in true.relations or key in model.undefined:
                start.relations[key] = true.relation(key) if low else possible(key)
        for r in rules:
            for a in r.body:
                if a.absent:
                    key = _of(a)
                    rows = against[key] if key in heads else possible(key) if low else true.relation(key)
                    start.relations["settled " + key[0], key[1], False] = rows
        if low:
            start.relations.update({k: p.all() for k, p in held.items() if p.paths})
        run = start.derive(_settled(rules, "settled"), max_rounds, held=held if low else None)
        model.per_round.extend(run.per_round)
        model.fixpoint = model.fixpoint and run.fixpoint
        grown.append(run.derived)
        return {k: run.base.relation(k) for k in heads if k in run.base.relations}

    grown: list[int] = []
    # At first all own rows are possible, so what is absent among them holds nowhere.
    certain = [r for r in own if not any(a.absent and _of(a) in heads for a in r.body)]
    under = least(certain, True, {})
    empty = {k: _none(true, k, under, own) for k in heads}
    while True:
        over = least(own, False, {**empty, **under})
        model.turns += 1
        left = {k: settle(without(rows, under[k]) if k in under else rows, "undefined") for k, rows in over.items()}
        if all(rows.isEmpty() for rows in left.values()):
            left = {}
            break
        under = least(own, True, {**empty, **over})
        if not grown[-1]:
            break
    for key, rows in under.items():
        true.relations[key] = rows
    for key, rows in left.items():
        if not rows.isEmpty():
            model.undefined[key] = rows.distinct()
    for key in heads - set(under):
        true.relations.setdefault(key, over[key].limit(0) if key in over else empty[key])


def _none(base: Base, key: Key, known: dict[Key, DataFrame], rules: list[Rule]) -> DataFrame:
    """No rows of a head; what is absent from it may ask nothing of its types."""
    return known[key].limit(0) if key in known else base.relation((key[0] + " none", key[1], False))
