"""A base of facts over DataFrames: queries, rules to a fixpoint, goals and checks."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scores import joint_score
from lodestar.plans.rules import ANY, Atom, Rule, Var, demanded, derived, matches, seed_of, without
from lodestar.plans.strata import groups, relevant, stratify
from lodestar.plans.wellfounded import well_founded
from lodestar.sources.facts import FACTS, long_form
from lodestar.sources.tables import Parts

Key = tuple[str, int, bool]
#: Parts of a relation, one a round, beyond which they are written anew as one.
MOST_PARTS = 64


@dataclass
class Derivation:
    """What a run of rules did; ``base`` holds base and derived facts."""

    base: Base
    per_round: list[int] = field(default_factory=list)
    fixpoint: bool = True
    undefined: dict[Key, DataFrame] = field(default_factory=dict)
    depths: dict[Key, list[tuple[DataFrame, int]]] = field(default_factory=dict)

    @property
    def rounds(self) -> int:
        return len([n for n in self.per_round if n])

    @property
    def derived(self) -> int:
        return sum(self.per_round)


class Relations(dict):
    """Relations by key; one given as a function is made when it is first used."""

    def __getitem__(self, key: Key) -> DataFrame:
        found = super().__getitem__(key)
        if callable(found):
            found = self[key] = found()
        return found

    def items(self) -> list[tuple[Key, DataFrame]]:
        return [(key, self[key]) for key in self]


class Base:
    """Relations by name, arity and sign. Columns are called ``a1 .. ak`` and keep their types.

    ``trace``, if given, gets an event for each query, derivation and round (``operators.traces.Trace``).
    """

    def __init__(self, spark: SparkSession, relations: dict[Key, DataFrame] | None = None, trace: Any = None) -> None:
        self.spark, self.trace = spark, trace
        self.relations = Relations(relations or {})

    def _event(self, kind: str, parents: tuple[str, ...] = (), **payload: Any) -> tuple[str, ...]:
        return (self.trace.record(kind, payload, parents),) if self.trace is not None else ()

    # -- facts ---------------------------------------------------------------------------

    def register(self, predicate: str, df: DataFrame, columns: list[str] | None = None, negated: bool = False) -> Base:
        """Any DataFrame's columns as a predicate; facts given before under it stay (a bag)."""
        rows = df.select(*(F.col(c).alias(f"a{i + 1}") for i, c in enumerate(columns or df.columns)))
        key = (predicate, len(rows.columns), negated)
        if key in self.relations:
            old = self.relations[key]
            if [t for _, t in old.dtypes] != [t for _, t in rows.dtypes]:
                raise TypeError(f"{predicate}: {rows.dtypes} does not fit {old.dtypes}")
            rows = old.union(rows)
        self.relations[key] = rows
        return self

    def declare(self, predicate: str, columns: list[str], df: Callable[[], DataFrame], negated: bool = False) -> Base:
        """``register`` for a DataFrame that is made only if the predicate is used; the predicate must be new."""
        key = (predicate, len(columns), negated)
        if key in self.relations:
            raise ValueError(f"{predicate} is known already")
        dict.__setitem__(self.relations, key, lambda: df().select(*(F.col(c).alias(f"a{i + 1}") for i, c in enumerate(columns))))
        return self

    def insert(self, predicate: str, rows: Iterable[tuple], negated: bool = False) -> Base:
        """A few facts given as tuples of strings."""
        rows = [tuple(map(str, r)) for r in rows]
        schema = ", ".join(f"a{i + 1} string" for i in range(len(rows[0])))
        return self.register(predicate, self.spark.createDataFrame(rows, schema), negated=negated)

    def load(self, facts: DataFrame) -> Base:
        """Facts in long form; a relation for each predicate, arity and sign among them."""
        keys = facts.select("predicate", F.size("args").alias("n"), "negated").distinct().collect()
        for predicate, n, negated in sorted(map(tuple, keys)):
            own = facts.where((F.col("predicate") == predicate) & (F.size("args") == n) & (F.col("negated") == negated))
            self.register(predicate, own.select(*(F.col("args")[i].alias(f"a{i + 1}") for i in range(n))), negated=negated)
        return self

    def facts(self) -> DataFrame:
        """All facts in long form."""
        empty = self.spark.createDataFrame([], FACTS)
        return reduce(DataFrame.union, (long_form(df, p, neg) for (p, _, neg), df in sorted(self.relations.items())), empty)

    def relation(self, key: Key, like: DataFrame | None = None) -> DataFrame:
        """A relation's rows; an unknown one is empty."""
        if key in self.relations:
            return self.relations[key]
        schema = ", ".join(f"a{i + 1} string" for i in range(key[1]))
        return self.spark.createDataFrame([], schema)

    def has(self, predicate: str, negated: bool = False) -> bool:
        """Whether a predicate is known, with any number of arguments."""
        return any(p == predicate and neg == negated for p, _, neg in self.relations)

    def predicates(self) -> list[str]:
        return sorted({("~" if neg else "") + p for p, _, neg in self.relations})

    def clear(self, predicate: str | None = None) -> Base:
        self.relations = Relations() if predicate is None else Relations({k: dict.__getitem__(self.relations, k) for k in self.relations if k[0] != predicate})
        return self

    def stats(self) -> DataFrame:
        """``predicate, facts`` with the total under a null predicate."""
        name = F.when(F.col("negated"), F.concat(F.lit("~"), "predicate")).otherwise(F.col("predicate"))
        return self.facts().select(name.alias("predicate")).rollup("predicate").agg(F.count("*").alias("facts"))

    # -- queries -------------------------------------------------------------------------

    def ask(self, goal: Atom) -> DataFrame:
        """``score`` 1 in one row if a fact matches a goal without variables; no row otherwise."""
        return matches(self.relation(goal.key), goal).limit(1).select(F.lit(1.0).alias("score"))

    def query(self, goal: Atom, k: int | None = None) -> DataFrame:
        """The goal's variables and ``score``, without repeats, best first, ties in order of the values.

        Constants and repeated variables filter the relation's scan. ``k`` limits the answers.
        """
        self._event("query", goal=str(goal), k=k)
        if not goal.variables:
            return self.ask(goal)
        bound = len([x for x in goal.args if not isinstance(x, Var)])
        value = joint_score(len(goal.args), bound, len(goal.variables))
        rows = matches(self.relation(goal.key), goal).distinct().withColumn("score", F.lit(value))
        return rows if k is None else rows.orderBy(F.desc("score"), *goal.variables).limit(k)

    def query_positions(self, goal: Atom, k: int) -> DataFrame:
        """``position, value, score``: the first ``k`` values of each free position on its own."""
        parts = []
        for i, x in enumerate(goal.args):
            if isinstance(x, Var):
                alone = Atom(goal.predicate, tuple(Var("value") if j == i else ANY if isinstance(y, Var) else y for j, y in enumerate(goal.args)), goal.negated)
                parts.append(self.query(alone, k).select(F.lit(i + 1).alias("position"), F.col("value").cast("string").alias("value"), "score"))
        return reduce(DataFrame.union, parts)

    def similar_exists(self, key: Key, rows: DataFrame, threshold: float) -> DataFrame:
        """The rows with a known fact that agrees in a share of positions above ``threshold``.

        From (k - 1) / k on that is equality in all positions, a semi join; below, rows meet on
        any set of positions large enough, each an equality join.
        """
        from itertools import combinations

        known, k = self.relation(key), key[1]
        need = int(threshold * k) + 1
        if need > k:
            return rows.limit(0)
        parts = [
            rows.join(known.select(*c).distinct(), list(c), "left_semi").select(*rows.columns)
            for c in combinations(rows.columns, need)
        ]
        return reduce(DataFrame.union, parts).distinct()

    # -- rules ---------------------------------------------------------------------------

    def derive(
        self,
        rules: list[Rule],
        max_rounds: int | None = None,
        naive: bool = False,
        beam: int | None = None,
        since: dict[Key, DataFrame] | None = None,
        held: dict[Key, Parts] | None = None,
        grouped: bool = True,
    ) -> Derivation:
        """Apply rules to a fixpoint; this base stays as it is.

        Rules whose heads depend on each other run together, after those they depend on. Each
        round joins only what the last one added with what is known (``naive``: all with all),
        drops repeats and known rows (nulls are equal), and settles the rest. A program without
        strata gets its well-founded model (``plans.wellfounded``): the base holds what is true,
        ``undefined`` the rows that are neither true nor false, which is warned of. So is a bound
        ``max_rounds`` reached before the fixpoint. With ``since``, rows that came to a base that was at its fixpoint, rounds
        start from those alone; ``held`` are the parts that derived relations are kept in. With
        ``grouped`` off, all rules of a stratum run together, so that rounds are depths of proofs.
        """
        strata = stratify(rules)
        if not strata.stratified:
            return self._well_founded(rules, max_rounds, strata.summary(), beam is None and since is None and grouped)
        out = Derivation(Base(self.spark, self.relations, self.trace))
        events = self._event("derive", rules=len(rules))
        fresh = dict(since) if since is not None else None
        held = {} if held is None else held
        levels = sorted({strata.levels.get(r.head.key, 0) for r in rules})
        whole = [[r for r in rules if strata.levels.get(r.head.key, 0) == level] for level in levels]
        for own in groups(rules) if grouped else whole:
            self._group(own, out, max_rounds, naive, beam, fresh, held, events)
        if not out.fixpoint:
            warnings.warn(f"no fixpoint within {max_rounds} rounds: rows that follow are missing", stacklevel=2)
        return out

    def _well_founded(self, rules: list[Rule], max_rounds: int | None, why: str, plain: bool) -> Derivation:
        if not plain:
            raise ValueError(f"{why}: beams, proofs and streams need strata")
        self._event("derive", rules=len(rules))
        model = well_founded(self, rules, max_rounds)
        if model.undefined:
            warnings.warn(f"{why}; undefined rows of {', '.join(sorted(k[0] for k in model.undefined))}", stacklevel=3)
        if not model.fixpoint:
            warnings.warn(f"no fixpoint within {max_rounds} rounds: rows are unsure", stacklevel=3)
        return Derivation(model.base, model.per_round, model.fixpoint, model.undefined)

    def _group(
        self, rules: list[Rule], out: Derivation, max_rounds: int | None, naive: bool, beam: int | None,
        since: dict[Key, DataFrame] | None, held: dict[Key, Parts], events: tuple[str, ...],
    ) -> None:
        base, heads = out.base, {r.head.key for r in rules}
        for key in heads & set(base.relations) - set(held):
            held[key] = Parts(self.spark, "facts")
            base.relations[key] = held[key].add(base.relations[key].distinct())
        fresh = dict(since or {})
        gathered: dict[Key, list[DataFrame]] = {}
        for turn in count() if max_rounds is None else range(max_rounds):
            found: dict[Key, list[DataFrame]] = {}
            for r in rules:
                if any(not a.absent and a.key not in base.relations for a in r.body):
                    continue  # nothing is known of an atom yet, so nothing follows
                if (turn == 0 and since is None) or naive:
                    found.setdefault(r.head.key, []).append(derived(r, lambda a, _: base.relation(_key(a)), beam))
                    continue
                for place in (i for i, a in enumerate(r.body) if not a.absent and a.key in fresh):

                    def relation(a: Atom, i: int, place: int = place) -> DataFrame:
                        return fresh[a.key] if i == place else base.relation(_key(a))

                    found.setdefault(r.head.key, []).append(derived(r, relation, beam))
            fresh, added = {}, 0
            for key, parts in found.items():
                new = reduce(DataFrame.union, (_fit(p, parts[0], key) for p in parts)).distinct() if len(parts) > 1 else parts[0]
                if key in base.relations:
                    new = without(_fit(new, base.relations[key], key), base.relations[key])
                part = (held.setdefault(key, Parts(self.spark, "facts"))).add(new)
                if n := part.count():
                    fresh[key], added = part, added + n
                    gathered.setdefault(key, []).append(part)
                    out.depths.setdefault(key, []).append((part, turn + 1))
                else:
                    held[key].forget_last()
            for key in fresh:
                if len(held[key].paths) > MOST_PARTS:
                    held[key].compact()
                base.relations[key] = held[key].all()
            for key in found:
                base.relations.setdefault(key, held[key].all())
            out.per_round.append(added)
            events = self._event("round", events, added=added) or events
            if not added:
                break
            if not any(a.key in fresh for r in rules for a in r.body):
                out.per_round.append(0)  # no rule reads what is new
                break
        else:
            out.fixpoint = False
        if since is not None:
            since.update({key: reduce(DataFrame.union, parts) for key, parts in gathered.items()})

    def demand(self, goal: Atom, rules: list[Rule], max_rounds: int | None = None) -> tuple[Derivation, Atom]:
        """What a goal asks for, derived, and the goal over the predicate that holds it.

        Absent atoms are asked for as others are, once all that can be asked is settled.
        Predicates that sum up, and what they depend on, are derived whole; so is a program
        without strata.
        """
        own = relevant(goal.key, rules)
        if not stratify(own).stratified:
            return self.derive(own, max_rounds), goal
        start = Base(self.spark, self.relations, self.trace)
        summed = {r.head.key for r in own if r.aggregates}
        if summed:
            whole = [r for key in summed for r in relevant(key, own)]
            start = start.derive(list(dict.fromkeys(whole)), max_rounds).base
            own = [r for r in own if r not in whole]
        if goal.key not in {r.head.key for r in own}:
            return Derivation(start), goal
        inner, rewritten = demanded(goal, own)
        if not stratify(rewritten).stratified:
            inner, rewritten = demanded(goal, own, sideways=False)
        seed, row = seed_of(goal)
        start.register(seed, self.spark.range(1).select(*(F.lit(x).alias(f"a{i + 1}") for i, x in enumerate(row))))
        return start.derive(rewritten, max_rounds), inner

    def follows(self, r: Rule) -> DataFrame:
        """What one rule gives over the facts that are known, as ``a1 .. ak`` without repeats.

        It is neither settled nor counted, so rows that are only handed on are made once, where they are used.
        """
        if any(a.key == r.head.key for a in r.body) or r.head.key in self.relations:
            raise ValueError(f"{r.head.predicate} needs rounds, or is known: derive it")
        return derived(r, lambda a, _: self.relation(_key(a)))

    def answers(self, goal: Atom, rules: list[Rule], max_rounds: int | None = None) -> DataFrame:
        """The goal's variables, deriving only what the goal asks for."""
        run, inner = self.demand(goal, rules, max_rounds)
        return run.base.query(inner).drop("score")

    def prove(self, goal: Atom, rules: list[Rule], max_depth: int = 10) -> DataFrame:
        """The goal's variables, ``similarity`` 1 and ``depth`` of the shortest proof, facts having depth 0.

        A round of rules proves what the rounds before it allow, so the round a row first
        appears in is its depth; ``max_depth`` bounds the rounds.
        """
        with warnings.catch_warnings():
            warnings.filterwarnings("ignore", "no fixpoint within")
            run = self.derive(relevant(goal.key, rules), max_depth, grouped=False)
        parts = [matches(self.relation(goal.key), goal).distinct().withColumn("depth", F.lit(0))] if goal.key in self.relations else []
        parts += [matches(df, goal).withColumn("depth", F.lit(n)) for df, n in run.depths.get(goal.key, [])]
        if not parts:
            return matches(self.relation(goal.key), goal).withColumn("similarity", F.lit(1.0)).withColumn("depth", F.lit(0))
        found = reduce(DataFrame.union, parts)
        keys = [c for c in found.columns if c != "depth"]
        return found.groupBy(*keys).agg(F.min("depth").alias("depth")).withColumn("similarity", F.lit(1.0))


NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _fit(rows: DataFrame, like: DataFrame, key: Key) -> DataFrame:
    """Rows with the relation's types: numbers are cast, other differences are refused."""
    columns = []
    for (name, kind), (_, wanted) in zip(rows.dtypes, like.dtypes, strict=True):
        if kind != wanted and not (kind in NUMBERS and wanted in NUMBERS):
            raise TypeError(f"{key[0]}: {name} is {kind}, the relation has {wanted}")
        columns.append(F.col(name).cast(wanted).alias(name))
    return rows.select(*columns)


def _key(a: Atom) -> Key:
    return (a.predicate, len(a.args), False) if a.absent else a.key
