"""Atoms, rules, and the DataFrame that a rule's body stands for.

Variables are ``Var``, all else in an atom is a constant; ``ANY`` matches anything. Binding
rows have a column for each variable. Catalyst orders and picks the joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scores import probe_score
from lodestar.operators.bands import band_join, can_rank, counted_beyond, has_band


@dataclass(frozen=True)
class Var:
    name: str


ANY = Var("_")


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple
    negated: bool = False
    absent: bool = False

    @property
    def key(self) -> tuple[str, int, bool]:
        """A relation is known by name, arity and sign."""
        return self.predicate, len(self.args), self.negated

    @property
    def variables(self) -> list[str]:
        """Names in order of first use; ``ANY`` is none."""
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var) and a != ANY))


def atom(predicate: str, *args: Any) -> Atom:
    return Atom(predicate, args)


def denied(predicate: str, *args: Any) -> Atom:
    """An explicitly negative fact."""
    return Atom(predicate, args, negated=True)


def absent(predicate: str, *args: Any) -> Atom:
    """Holds where no such positive fact is known; free variables in it match anything, repeats alike."""
    return Atom(predicate, args, absent=True)


#: Comparison, and the bounds of right - left that it implies.
COMPARISONS = {"<": (0, None), "<=": (0, None), ">": (None, 0), ">=": (None, 0), "=": (0, 0), "!=": (None, None)}


@dataclass(frozen=True)
class Condition:
    """A condition on bound values: ``left op right``, or with op ``within``, low <= right - left <= high."""

    left: Any
    op: str
    right: Any
    low: Any = None
    high: Any = None

    @property
    def variables(self) -> list[str]:
        return [x.name for x in (self.left, self.right) if isinstance(x, Var)]

    @property
    def condition(self) -> Column:
        a, b = (F.col(x.name) if isinstance(x, Var) else F.lit(x) for x in (self.left, self.right))
        if self.op == "within":
            return (b >= a + F.lit(self.low)) & (b <= a + F.lit(self.high))
        compared = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "!=": a != b}
        return compared[self.op]


def compare(left: Any, op: str, right: Any) -> Condition:
    """A body's condition that two values compare so: one of <, <=, >, >=, =, !=. Nulls never do."""
    if op not in COMPARISONS:
        raise ValueError(f"no comparison {op}")
    return Condition(left, op, right, *COMPARISONS[op])


def within(left: Any, right: Any, low: Any, high: Any) -> Condition:
    """A body's condition that ``low <= right - left <= high``; for times the bounds are intervals (``timedelta``)."""
    return Condition(left, "within", right, low, high)


@dataclass(frozen=True)
class Aggregate:
    """A head's argument that sums up a variable over the rows that the other arguments share."""

    kind: str
    over: Var


def total(kind: str, over: Var) -> Aggregate:
    """``count`` counts different values; ``sum`` and ``avg`` go over the body's different bindings; ``min``, ``max``."""
    if kind not in ("count", "sum", "avg", "min", "max"):
        raise ValueError(f"no aggregate {kind}")
    return Aggregate(kind, over)


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    tests: tuple[Condition, ...] = ()

    def __post_init__(self) -> None:
        """Reject rules with a variable of the head or of a test that no positive atom binds."""
        bound = {v for a in self.body if not a.absent for v in a.variables}
        asked = [*self.head.variables, *(x.over.name for x in self.aggregates), *(v for t in self.tests for v in t.variables)]
        if loose := [v for v in asked if v not in bound]:
            raise ValueError(f"unsafe rule for {self.head.predicate}: {', '.join(loose)} not bound by a positive atom")
        if ANY in self.head.args or self.head.absent:
            raise ValueError("a head can't be open or absent")

    @property
    def aggregates(self) -> list[Aggregate]:
        return [x for x in self.head.args if isinstance(x, Aggregate)]


def rule(head: Atom, *body: Atom | Condition) -> Rule:
    return Rule(head, tuple(x for x in body if isinstance(x, Atom)), tuple(x for x in body if isinstance(x, Condition)))


def matches(relation: DataFrame, a: Atom) -> DataFrame:
    """The relation's rows that agree with the atom's constants and repeats; a column for each variable."""
    conditions: list[Column] = []
    first: dict[str, str] = {}
    for column, arg in zip(relation.columns, a.args, strict=True):
        if not isinstance(arg, Var):
            conditions.append(F.col(column) == F.lit(arg))
        elif arg != ANY and arg.name in first:
            conditions.append(F.col(column) == F.col(first[arg.name]))
        elif arg != ANY:
            first[arg.name] = column
    kept = reduce(lambda df, c: df.where(c), conditions, relation)
    return kept.select(*(F.col(c).alias(v) for v, c in first.items())) if first else kept.select(F.lit(1).alias("_found"))


def without(rows: DataFrame, known: DataFrame, kind: str = "left_anti") -> DataFrame:
    """The rows that aren't among the known ones, by as many columns as those have, in order; nulls are equal."""
    other = known.select(*(F.col(c).alias(f"_known{i}") for i, c in enumerate(known.columns)))
    same = (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(rows.columns, other.columns, strict=False))
    return rows.join(other, reduce(Column.__and__, same), kind)


def among(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that are among the known ones; nulls are equal."""
    return without(rows, known, "left_semi")


Lookup = Callable[[Atom, int], DataFrame]


def bindings(
    body: tuple[Atom, ...], relation: Lookup, scored: bool = False, beam: int | None = None, tests: tuple[Condition, ...] = ()
) -> DataFrame:
    """Rows of variables that satisfy the body.

    Positive atoms are joined on shared variables in turn; one that brings no new variable
    is a semi join, one that shares none a cross join, or, where a test ties it to what is
    bound, a band join. Tests are applied as soon as their variables are bound. Absent atoms are anti joins on their
    bound variables, after the positive ones. ``scored`` adds ``score``, the product of the
    closed-form scores of the probed atoms; ``beam`` keeps the best rows after each join.
    """
    found: DataFrame | None = None
    score = 1.0
    positive = [(i, a) for i, a in enumerate(body) if not a.absent]
    for i, a in positive:
        rows, free = matches(relation(a, i), a), a.variables
        if found is None:
            found, new = rows.distinct() if not free else rows, free
            known = len(a.args) - sum(isinstance(x, Var) for x in a.args)
        else:
            shared = [v for v in free if v in found.columns]
            new = [v for v in free if v not in shared]
            known = len(a.args) - len([x for x in a.args if isinstance(x, Var) and (x == ANY or x.name in new)])
            if not free:
                found = found.join(rows.limit(1), F.lit(True), "left_semi")
            elif not new:
                found = found.join(rows, shared, "left_semi")
            elif shared:
                found = found.join(rows, shared, "inner")
            else:
                found = _apart(found, rows, new, tests)
        for t in tests:
            if all(v in found.columns for v in t.variables) and (i == positive[0][0] or not t.variables or any(v in new for v in t.variables)):
                found = found.where(t.condition)
        score *= probe_score(len(a.args), known, len(new))
        if beam is not None:
            found = found.withColumn("score", F.lit(score)).orderBy(F.desc("score"), *a.variables).limit(beam).drop("score")
    if found is None:
        raise ValueError("a body needs a positive atom")
    for i, a in enumerate(body):
        if a.absent:
            rows = matches(relation(a, i), a)
            shared = [v for v in a.variables if v in found.columns]
            if shared:
                found = found.join(rows.select(*shared).distinct(), shared, "left_anti")
            else:
                found = found.join(rows.limit(1), F.lit(True), "left_anti")
    return found.withColumn("score", F.lit(score)) if scored else found


def _apart(found: DataFrame, rows: DataFrame, new: list[str], tests: tuple[Condition, ...]) -> DataFrame:
    """Rows without a variable in common: a band join if a test ties numbers or times of both, else a cross join."""
    for t in tests:
        if _ties(t, found.columns, new):
            left, right = t.variables
            one, other = (rows, found) if left in new else (found, rows)
            if has_band(one, other, left, right):
                return band_join(one, other, left, right, t.low, t.high)
    return found.crossJoin(rows)


def _ties(t: Condition, known: list[str], new: list[str]) -> bool:
    """Whether a test with bounds stands between a variable that is known and a new one."""
    if len(t.variables) < 2 or (t.low is None and t.high is None):
        return False
    left, right = t.variables
    return (left in known and right in new) or (left in new and right in known)


def derived(r: Rule, relation: Lookup, beam: int | None = None) -> DataFrame:
    """The head's rows as ``a1 .. ak``, without repeats; nothing follows from no rows, not even a count of 0."""
    if beam is None and (counted := _counted(r, relation)) is not None:
        return counted
    found = bindings(r.body, relation, beam=beam, tests=r.tests)
    if r.aggregates:
        made = {
            f"_total{i}": F.count_distinct(x.over.name) if x.kind == "count" else getattr(F, x.kind)(x.over.name)
            for i, x in enumerate(r.head.args)
            if isinstance(x, Aggregate)
        }
        used = list(dict.fromkeys([*r.head.variables, *(x.over.name for x in r.aggregates)]))
        # Bindings differ by all variables for sums; for the others, those used will do.
        whole = any(x.kind in ("sum", "avg") for x in r.aggregates)
        rows = found.distinct() if whole else found.select(*used).distinct()
        sums = rows.groupBy(*r.head.variables).agg(F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in made.items()))
        columns = [
            (F.col(x.name) if isinstance(x, Var) else F.col(f"_total{i}") if isinstance(x, Aggregate) else F.lit(x)).alias(f"a{i + 1}")
            for i, x in enumerate(r.head.args)
        ]
        return sums.where("_rows > 0").select(*columns)
    columns = [
        (F.col(x.name) if isinstance(x, Var) else F.lit(x)).alias(f"a{i + 1}") for i, x in enumerate(r.head.args)
    ]
    return found.select(*columns) if _differ(r, relation) else found.select(*columns).distinct()


def _differ(r: Rule, relation: Lookup) -> bool:
    """Whether the head's rows differ as they are made: those of two atoms without a common variable, if the head's own of each occur once there."""
    if len(r.body) != 2 or any(x.absent for x in r.body) or set(r.body[0].variables) & set(r.body[1].variables):
        return False
    for i, x in enumerate(r.body):
        own = [v for v in x.variables if v in r.head.variables]
        if not own or not matches(relation(x, i), x).groupBy(*own).count().where("count > 1").isEmpty():
            return False
    return True


def _counted(r: Rule, relation: Lookup) -> DataFrame | None:
    """The head's rows where it counts what lies on one side of a value, without the pairs; None for other rules.

    Those are rules of two atoms without a common variable, tied by one comparison, whose head
    has one count of a variable of the one atom, and else variables of the other.
    """
    if len(r.body) != 2 or any(x.absent for x in r.body) or len(r.tests) != 1 or [x.kind for x in r.aggregates] != ["count"]:
        return None
    test, over = r.tests[0], r.aggregates[0].over.name
    if test.op not in ("<", "<=", ">", ">=") or len(test.variables) < 2 or set(r.body[0].variables) & set(r.body[1].variables):
        return None
    i = next(i for i, x in enumerate(r.body) if over in x.variables)
    other, own = r.body[1 - i], r.body[i]
    (a,), (b,) = ([v for v in test.variables if v in x.variables] or [None] for x in (other, own)) if _ties(test, other.variables, own.variables) else ((None,), (None,))
    if a is None or b is None or not r.head.variables or not set(r.head.variables) <= set(other.variables):
        return None
    left, right = matches(relation(other, 1 - i), other), matches(relation(own, i), own)
    if not can_rank(left, right, a, b):
        return None
    op = test.op if test.variables == [b, a] else {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[test.op]
    rows = counted_beyond(left, right, r.head.variables, a, b, over, op)
    return rows.select(*(
        (F.col("_total") if isinstance(x, Aggregate) else F.col(x.name) if isinstance(x, Var) else F.lit(x)).alias(f"a{j + 1}")
        for j, x in enumerate(r.head.args)
    ))


def demanded(goal: Atom, rules: list[Rule], sideways: bool = True) -> tuple[Atom, list[Rule]]:
    """Rewrite rules so that only what a goal with constants asks for is derived.

    Each predicate gets, per pattern of bound arguments, a relation of asked-for arguments;
    a rule runs only on those, and asks on for its body from left to right, for absent atoms
    last. Returns the goal over the rewritten predicate; its seed is the rule without a body
    that the caller registers as facts: see ``seed_of``.

    What is asked for may depend on answers (``sideways``), which binds more but can put
    absence on a cycle. Without, it follows from what was asked and from base facts alone, so
    all of it is settled before anything is derived and the strata are those of the rules.

    Where a goal's predicate is asked for only by rules that end in it and hand its free
    arguments through, all that its asked-for arguments give are answers of the goal, so the
    answers are derived at once from what was asked, and not passed back link by link.
    """
    heads = {r.head.key for r in rules}
    out: list[Rule] = []
    done: set[tuple] = set()

    def name(a: Atom, bound: tuple[bool, ...]) -> str:
        return f"{'~' * a.negated}{a.predicate}?{''.join('b' if b else 'f' for b in bound)}"

    def ask(a: Atom, bound: tuple[bool, ...]) -> Atom:
        return Atom(f"ask {name(a, bound)}", tuple(x for x, b in zip(a.args, bound, strict=True) if b) or (1,))

    def pattern(a: Atom, known: set[str]) -> tuple[bool, ...]:
        return tuple(not isinstance(x, Var) or x.name in known for x in a.args)

    def ordered(body: tuple[Atom, ...], guard: Atom) -> list[Atom]:
        """Positive atoms, at each step the one with most bound arguments; then absent ones."""
        left, known, out = [x for x in body if not x.absent], set(guard.variables), []
        while left:
            best = max(left, key=lambda x: sum(pattern(x, known)))
            left.remove(best)
            out.append(best)
            known |= set(best.variables)
        return out + [x for x in body if x.absent]

    first = pattern(goal, set())
    handed = _handed_through(goal, first, rules)
    answer = f"{name(goal, first)} answers"
    todo = [(goal, first)]
    while todo:
        a, bound = todo.pop()
        if (a.key, bound) in done:
            continue
        done.add((a.key, bound))
        through = handed and a.key == goal.key
        free = [i for i, b in enumerate(bound) if not b]
        for r in rules:
            if r.head.key != a.key:
                continue
            guard = ask(r.head, bound)
            body, asking = [guard], [guard]
            if through and (again := next((x for x in r.body if x.key == goal.key and not x.absent), None)):
                wanted = ask(again, bound)
                out += [Rule(wanted, (guard, *(x for x in r.body if x is not again)), r.tests)] if wanted != guard else []
                continue
            for x in ordered(r.body, guard):
                plain = Atom(x.predicate, x.args, x.negated and not x.absent)
                if plain.key not in heads:
                    body.append(x)
                    asking += [] if x.absent else [x]
                    continue
                known = {v for y in asking for v in y.variables}
                inner = pattern(plain, known)
                wanted = ask(plain, inner)
                if wanted != guard:
                    tests = tuple(t for t in r.tests if all(v in known for v in t.variables))
                    out.append(Rule(wanted, tuple(asking), tests))
                todo.append((plain, inner))
                found = Atom(name(plain, inner), x.args, absent=x.absent)
                body.append(found)
                asking += [found] if sideways and not x.absent else []
            held = Atom(answer, tuple(r.head.args[i] for i in free)) if through else Atom(name(r.head, bound), r.head.args)
            out.append(Rule(held, tuple(body), r.tests))
        # Base facts of a derived predicate take part as well.
        plain = tuple(Var(f"X{i}") for i in range(len(a.args)))
        held = Atom(answer, tuple(plain[i] for i in free)) if through else Atom(name(a, bound), plain)
        out.append(Rule(held, (ask(Atom(a.predicate, plain, a.negated), bound), Atom(a.predicate, plain, a.negated))))
    if handed:
        return Atom(answer, tuple(x for x, b in zip(goal.args, first, strict=True) if not b)), out
    return Atom(name(goal, first), goal.args), out


def _handed_through(goal: Atom, bound: tuple[bool, ...], rules: list[Rule]) -> bool:
    """Whether rules for the goal that ask for its predicate again only hand its free arguments through.

    Besides that atom they hold base facts alone, which don't name the free arguments, and the
    bound ones stay bound; some rule asks again, and no predicate below the goal's asks for it.
    """
    heads = {r.head.key for r in rules}
    own = [r for r in rules if r.head.key == goal.key]
    below: set = set()
    todo = [_of(x) for r in own for x in r.body if _of(x) != goal.key]
    while todo:
        if (key := todo.pop()) not in below:
            below.add(key)
            todo += [_of(x) for r in rules if r.head.key == key for x in r.body]
    free = [i for i, b in enumerate(bound) if not b]
    if goal.key in below or not free or len(free) == len(bound) or any(r.aggregates for r in own):
        return False
    recursive = False
    for r in own:
        again = [x for x in r.body if _of(x) == goal.key]
        if not again:
            continue
        recursive = True
        rest = [x for x in r.body if x is not again[0]]
        kept = [r.head.args[i] for i in free]
        names = {x.name for x in kept if isinstance(x, Var)}
        known = {x.name for i, x in enumerate(r.head.args) if bound[i] and isinstance(x, Var)} | {v for x in rest if not x.absent for v in x.variables}
        used = known | {v for x in rest for v in x.variables} | {v for t in r.tests for v in t.variables}
        if (
            len(again) > 1 or again[0].absent or any(_of(x) in heads for x in rest)
            or len(names) < len(free) or names & used or [again[0].args[i] for i in free] != kept
            or any(isinstance(x, Var) and x.name not in known for i, x in enumerate(again[0].args) if bound[i])
        ):
            return False
    return recursive


def _of(a: Atom) -> tuple[str, int, bool]:
    return a.predicate, len(a.args), a.negated and not a.absent


def seed_of(goal: Atom) -> tuple[str, tuple]:
    """The predicate and the only row of what a goal asks for."""
    bound = "".join("f" if isinstance(x, Var) else "b" for x in goal.args)
    return f"ask {'~' * goal.negated}{goal.predicate}?{bound}", tuple(x for x in goal.args if not isinstance(x, Var)) or (1,)
