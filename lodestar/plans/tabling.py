"""Answer tables: what a goal was answered with answers narrower goals later on."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Atom, Rule, Var, matches
from lodestar.plans.strata import Key, dependencies, relevant
from lodestar.sources.tables import drop, settle


def _whole(goal: Atom) -> Atom:
    """The goal with a variable of its own in every free place; repeats stay repeats."""
    names: dict[Any, Var] = {}
    args = []
    for i, x in enumerate(goal.args):
        args.append(x if not isinstance(x, Var) else Var(f"V{i}") if x == ANY else names.setdefault(x, Var(f"V{i}")))
    return Atom(goal.predicate, tuple(args), goal.negated)


def covers(general: Atom, narrow: Atom) -> bool:
    """Whether every fact that matches ``narrow`` matches ``general``."""
    if general.key != narrow.key:
        return False
    stands: dict[str, Any] = {}
    for g, n in zip(general.args, narrow.args, strict=True):
        if not isinstance(g, Var):
            if isinstance(n, Var) or type(g) is not type(n) or g != n:
                return False
        elif g != ANY and stands.setdefault(g.name, n) != n:
            return False
        elif g != ANY and n == ANY and sum(x == g for x in general.args) > 1:
            return False
    return True


@dataclass
class Table:
    goal: Atom
    rows: DataFrame
    seen: dict[Key, Any]


@dataclass
class Tabled:
    """Goals over a base and rules, their answers kept in the shared folder.

    A table holds the facts that match a goal. It answers that goal and any narrower one
    without a round of rules, until a predicate that its goal depends on changes in the base;
    it is then dropped, as it is by ``clear``. The tables' number is bounded by ``most``: the
    one unused for longest goes first.
    """

    base: Base
    rules: list[Rule]
    most: int = 256
    tables: list[Table] = field(default_factory=list)
    hits: int = 0
    misses: int = 0

    def _seen(self, goal: Atom) -> dict[Key, Any]:
        own = relevant(goal.key, self.rules)
        keys = {goal.key} | {k for head, body, _ in dependencies(own) for k in (head, body)}
        return {k: dict.get(self.base.relations, k) for k in keys}

    def _valid(self, table: Table) -> bool:
        """Whether the base still holds the very relations that the table was made from."""

        def same(before: Any, now: Any) -> bool:
            return before is now or (callable(before) and now is not None and not callable(now))

        now = self._seen(table.goal)
        return all(same(table.seen.get(k), x) for k, x in now.items())

    def answers(self, goal: Atom) -> DataFrame:
        """The goal's variables; one without variables gives one row, ``_found``, if it holds."""
        for table in [t for t in self.tables if not self._valid(t)]:
            self._drop(table)
        table = next((t for t in self.tables if covers(t.goal, goal)), None)
        if table is None:
            self.misses += 1
            whole = _whole(goal)
            seen = self._seen(goal)
            run, inner = self.base.demand(whole, self.rules)
            found = run.base.query(inner)
            kept = found.select(*((F.col(x.name) if isinstance(x, Var) else F.lit(x)).alias(f"a{i + 1}") for i, x in enumerate(whole.args)))
            table = Table(whole, settle(kept.distinct(), "answers"), seen)
        else:
            self.hits += 1
            self.tables.remove(table)
        self.tables.append(table)
        while len(self.tables) > self.most:
            self._drop(self.tables[0])
        return matches(table.rows, goal).distinct()

    def _drop(self, table: Table) -> None:
        self.tables.remove(table)
        drop(table.rows)

    def clear(self, predicate: str | None = None) -> None:
        """Drop all tables, or those whose goals depend on a predicate."""
        for table in list(self.tables):
            if predicate is None or any(k[0] == predicate for k in table.seen):
                self._drop(table)

    def stats(self) -> dict[str, int]:
        return {"tables": len(self.tables), "hits": self.hits, "misses": self.misses}
