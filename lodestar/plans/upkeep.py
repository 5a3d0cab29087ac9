"""What follows from facts that come and go: derived relations kept up without deriving them anew.

Group by group, in the order of the strata. First everything is overdeleted that some gone row
(or, under an absent atom, some new row) took part in deriving. What still has a derivation
from what is left comes back, and what follows from new rows (or from rows gone under an
absent atom) is added, both in rounds over what the last round brought. The net change of the
group is then what the groups above it start from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from lodestar.plans.rules import ANY, Atom, Rule, Var, among, derived, without
from lodestar.plans.strata import Key, groups, stratify
from lodestar.sources.tables import settle

if TYPE_CHECKING:
    from lodestar.plans.base import Base

Changes = dict[Key, DataFrame]
Revise = Callable[[Key, DataFrame | None, DataFrame | None], DataFrame]


def _of(a: Atom) -> Key:
    return (a.predicate, len(a.args), False) if a.absent else a.key


def _changed(r: Rule, place: int, rows: DataFrame, relation: Callable[[Atom], DataFrame], kept: bool) -> DataFrame:
    """The head's rows for which the body atom at a place meets the rows; ``kept``: an absent one must hold besides."""
    a = r.body[place]
    if not a.absent:
        return derived(r, lambda x, i: rows if i == place else relation(x))
    bound = {v for x in r.body if not x.absent for v in x.variables}
    names = [x for x in a.args if isinstance(x, Var)]
    args = tuple(ANY if isinstance(x, Var) and x.name not in bound and names.count(x) == 1 else x for x in a.args)
    rest = r.body if kept else r.body[:place] + r.body[place + 1 :]
    body = (*rest, Atom(a.predicate, args))
    return derived(replace(r, body=body), lambda x, i: rows if i == len(body) - 1 else relation(x))


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def upkeep(base: Base, rules: list[Rule], plus: Changes, minus: Changes, revise: Revise, scratch: list[DataFrame]) -> tuple[Base, Changes, Changes]:
    """A base at the fixpoint of stratified rules, kept up after its facts changed; and all net changes.

    ``plus`` holds rows that are new, ``minus`` rows that are gone, of relations that rules
    don't derive. ``revise`` makes a relation's new rows out of its changes; tables in
    ``scratch`` can go once the result is written.
    """
    from lodestar.plans.base import Base, _fit

    if not stratify(rules).stratified or any(r.aggregates for r in rules):
        raise ValueError("upkeep needs rules with strata and without heads that sum up")
    old = Base(base.spark, base.relations, base.trace)
    new = Base(base.spark, base.relations, base.trace)
    plus, minus = dict(plus), dict(minus)
    for key in plus.keys() | minus.keys():
        new.relations[key] = revise(key, plus.get(key), minus.get(key))

    def settled(rows: DataFrame) -> DataFrame | None:
        table = settle(rows, "upkeep")
        scratch.append(table)
        return None if table.isEmpty() else table

    for own in groups(rules):
        heads = {r.head.key for r in own}

        def rounds(first: list[tuple[Key, DataFrame]], state: Base, accept: Callable[[Key, DataFrame], DataFrame], own: list[Rule] = own) -> dict[Key, list[DataFrame]]:
            """Rows by head: the first ones, and what follows from each round's in turn."""
            gathered: dict[Key, list[DataFrame]] = {}
            found: dict[Key, list[DataFrame]] = {}
            for key, rows in first:
                found.setdefault(key, []).append(rows)
            while found:
                fresh: Changes = {}
                for key, parts in found.items():
                    rows = _united([_fit(p, state.relations.get(key, parts[0]), key) for p in parts]).distinct()
                    if (part := settled(accept(key, rows))) is not None:
                        fresh[key] = part
                for key, part in fresh.items():
                    gathered.setdefault(key, []).append(part)
                    gained(key, part)
                found = {}
                for r in own:
                    for i, a in enumerate(r.body):
                        if not a.absent and a.key in fresh and all(x.absent or x.key in state.relations for x in r.body):
                            found.setdefault(r.head.key, []).append(_changed(r, i, fresh[a.key], lambda x: state.relation(_of(x)), False))
            return gathered

        def meets(r: Rule, state: Base, changes: Changes, absents: Changes, kept: bool) -> list[tuple[Key, DataFrame]]:
            if any(not x.absent and x.key not in state.relations for x in r.body):
                return []
            touched = [(i, (absents if a.absent else changes).get(_of(a))) for i, a in enumerate(r.body)]
            return [(r.head.key, _changed(r, i, rows, lambda x: state.relation(_of(x)), kept)) for i, rows in touched if rows is not None]

        # What a gone row, or one new where it was absent, took part in.
        over: Changes = {}

        def gained(key: Key, part: DataFrame, over: Changes = over) -> None:
            over[key] = over[key].union(part) if key in over else part

        def known(key: Key, rows: DataFrame, over: Changes = over) -> DataFrame:
            rows = among(rows, old.relation(key))
            return without(rows, over[key]) if key in over else rows

        starts = [x for r in own for x in meets(r, old, minus, plus, False) if r.head.key in old.relations]
        rounds(starts, old, known)

        # What is left, what comes back, and what is new.
        for key in over:
            new.relations[key] = without(old.relations[key], over[key])

        def gained(key: Key, part: DataFrame) -> None:  # noqa: F811
            new.relations[key] = new.relations[key].union(part) if key in new.relations else part

        def unknown(key: Key, rows: DataFrame) -> DataFrame:
            return without(rows, new.relations[key]) if key in new.relations else rows

        starts = []
        for r in own:
            if r.head.key in over and all(x.absent or x.key in new.relations for x in r.body):
                gone = Atom("gone", r.head.args)
                again = replace(r, body=(gone, *r.body))
                starts.append((r.head.key, derived(again, lambda x, i, rows=over[r.head.key]: rows if i == 0 else new.relation(_of(x)))))
            starts += meets(r, new, plus, minus, True)
        added = rounds(starts, new, unknown)

        for key in sorted(heads & (over.keys() | added.keys())):
            more = _united(added[key]) if key in added else None
            gone = over.get(key)
            if gone is not None and more is not None:
                more, gone = without(more, old.relation(key)), without(gone, more)
            came = settled(more) if more is not None and key in old.relations else more
            went = settled(gone) if gone is not None else None
            if came is not None:
                plus[key] = came
            if went is not None:
                minus[key] = went
            if came is not None or went is not None:
                new.relations[key] = revise(key, came, went)
            else:
                new.relations[key] = old.relations[key]
    return new, plus, minus
