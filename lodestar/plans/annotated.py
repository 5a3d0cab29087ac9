"""Rules over facts with values: every derived row with the best value that some proof of it has.

An algebra says how the values of a body's facts combine and which of two values is better.
Rounds are semi-naive over values: what a round passes on are rows that are new or whose value
got better, so a row moves again whenever a better proof of it turns up, and rounds end when
none does. Shortest paths are sums with the least being best: a minimum inside recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.base import Base, _fit
from lodestar.plans.rules import Atom, Rule, Var, bindings, matches
from lodestar.plans.strata import Key, groups, stratify
from lodestar.sources.tables import Parts, drop, settle


@dataclass(frozen=True)
class Algebra:
    """``times`` combines two values, ``best`` is ``max`` or ``min``, ``one`` a fact's value without weight.

    ``fine`` is what a weight must satisfy so that going round a cycle never makes a value better.
    """

    times: Callable[[Column, Column], Column]
    best: str
    one: float
    fine: Callable[[Column], Column]

    def pick(self, values: Column | str) -> Column:
        return getattr(F, self.best)(values)

    def better(self, new: Column, old: Column) -> Column:
        return new > old if self.best == "max" else new < old


PRODUCT = Algebra(lambda x, y: x * y, "max", 1.0, lambda w: w.between(0.0, 1.0))
WEAKEST = Algebra(lambda x, y: F.least(x, y), "max", 1.0, lambda w: w <= 1.0)
SHORTEST = Algebra(lambda x, y: x + y, "min", 0.0, lambda w: w >= 0.0)


@dataclass
class Valued:
    """Relations as ``a1 .. ak, value``."""

    spark: object
    relations: dict[Key, DataFrame] = field(default_factory=dict)
    rounds: int = 0
    fixpoint: bool = True

    def query(self, goal: Atom, k: int | None = None) -> DataFrame:
        """The goal's variables and the best ``value`` each; with ``k``, so many at most, best first."""
        rows = matches(self.relations[goal.key], Atom(goal.predicate, (*goal.args, Var("value"))))
        found = rows.groupBy(*goal.variables).agg(getattr(F, self.best)("value").alias("value"))
        order = F.desc("value") if self.best == "max" else F.asc("value")
        return found if k is None else found.orderBy(order, *goal.variables).limit(k)

    best: str = "max"


#: Parts of a relation beyond which its best values are written anew as one.
MOST_PARTS = 8


def best_values(
    base: Base, rules: list[Rule], weights: dict[str, DataFrame], algebra: Algebra = PRODUCT, max_rounds: int | None = None
) -> Valued:
    """The best value of every row that follows.

    ``weights`` holds predicates whose last column is each fact's value; repeated facts count
    with their best one. Facts of ``base`` have the algebra's ``one``. A weight that is null, or
    that a cycle could make better and better, raises on use. Absent atoms ask whether a row
    follows at all; rules need strata. ``max_rounds`` bounds the rounds of each group of rules.
    """
    if not stratify(rules).stratified or any(r.aggregates for r in rules):
        raise ValueError("values need rules with strata and without heads that sum up")
    out = Valued(base.spark, best=algebra.best)
    for key, rows in base.relations.items():
        out.relations[key] = rows.distinct().withColumn("value", F.lit(algebra.one))
    for predicate, rows in weights.items():
        args = [f"a{i + 1}" for i in range(len(rows.columns) - 1)]
        rows, value = rows.toDF(*args, "weight"), F.col("weight").cast("double")
        bad = F.raise_error(F.lit(f"{predicate}: a weight is null or out of bounds")).cast("double")
        held = rows.select(*args, F.when(F.coalesce(algebra.fine(value), F.lit(False)), value).otherwise(bad).alias("value"))
        key = (predicate, len(args), False)
        if key in out.relations:
            held = held.union(out.relations[key])
        out.relations[key] = held.groupBy(*args).agg(algebra.pick("value").alias("value"))
    for own in groups(rules):
        _rounds(out, own, algebra, max_rounds)
    return out


def _valued(r: Rule, relation: Callable[[Atom, int], DataFrame], algebra: Algebra) -> DataFrame:
    """The head's rows with the best value over the body's bindings."""
    body = tuple(a if a.absent else Atom(a.predicate, (*a.args, Var(f"_value{i}")), a.negated) for i, a in enumerate(r.body))
    found = bindings(body, lambda a, i: relation(r.body[i], i), tests=r.tests)
    values = [F.col(f"_value{i}") for i, a in enumerate(r.body) if not a.absent]
    args = [(F.col(x.name) if isinstance(x, Var) else F.lit(x)).alias(f"a{i + 1}") for i, x in enumerate(r.head.args)]
    rows = found.select(*args, reduce(algebra.times, values).alias("value"))
    return rows.groupBy(*(f"a{i + 1}" for i in range(len(args)))).agg(algebra.pick("value").alias("value"))


def _improved(rows: DataFrame, known: DataFrame, algebra: Algebra) -> DataFrame:
    """The rows that aren't known or are better than what is known of them."""
    other = known.toDF(*(f"_known{i}" for i in range(len(known.columns))))
    args, last = rows.columns[:-1], other.columns[-1]
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_known{i}")) for i, c in enumerate(args))) if args else F.lit(True)
    joined = rows.join(other, same, "left")
    return joined.where(F.col(last).isNull() | algebra.better(F.col("value"), F.col(last))).select(*rows.columns)


def _rounds(out: Valued, own: list[Rule], algebra: Algebra, max_rounds: int | None) -> None:
    spark, heads = out.spark, {r.head.key for r in own}
    held: dict[Key, Parts] = {}

    def view(key: Key) -> DataFrame:
        rows = held[key].all()
        return rows.groupBy(*rows.columns[:-1]).agg(algebra.pick("value").alias("value"))

    for key in heads & set(out.relations):
        held[key] = Parts(spark, "values")
        held[key].add(out.relations[key])
        out.relations[key] = view(key)

    def asked(a: Atom) -> Key:
        return (a.predicate, len(a.args), False) if a.absent else a.key

    def relation(a: Atom) -> DataFrame:
        key = asked(a)
        if key not in out.relations:
            return Base(spark).relation(key)
        return out.relations[key].drop("value") if a.absent else out.relations[key]

    fresh: dict[Key, DataFrame] = {}
    for turn in count() if max_rounds is None else range(max_rounds):
        found: dict[Key, list[DataFrame]] = {}
        for r in own:
            if any(not a.absent and a.key not in out.relations for a in r.body):
                continue
            if turn == 0:
                found.setdefault(r.head.key, []).append(_valued(r, lambda a, _: relation(a), algebra))
                continue
            for place in (i for i, a in enumerate(r.body) if not a.absent and a.key in fresh):
                rows = _valued(r, lambda a, i, place=place: fresh[a.key] if i == place else relation(a), algebra)
                found.setdefault(r.head.key, []).append(rows)
        fresh = {}
        for key, parts in found.items():
            like = out.relations.get(key, parts[0])
            rows = reduce(DataFrame.union, (_fit(p, like, key) for p in parts))
            if len(parts) > 1:
                rows = rows.groupBy(*rows.columns[:-1]).agg(algebra.pick("value").alias("value"))
            part = settle(_improved(rows, out.relations[key], algebra) if key in out.relations else rows, "improved")
            if part.isEmpty() and key in out.relations:
                drop(part)
                continue
            fresh[key] = part
        for key, part in fresh.items():
            kept = held.setdefault(key, Parts(spark, "values"))
            kept.add(part)
            if len(kept.paths) > MOST_PARTS:
                whole = Parts(spark, "values")
                whole.add(view(key))
                held[key] = whole
            out.relations[key] = view(key)
        out.rounds += bool(fresh)
        if not any(not part.isEmpty() for part in fresh.values()):
            break
    else:
        out.fixpoint = False
    for key in held:
        out.relations[key] = settle(view(key), "values")
