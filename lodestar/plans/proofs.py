"""Proofs of derived facts: the steps that rules allow, least proofs, and how many proofs there are.

A step is one use of a rule: the fact it gives, the rule's number, and the facts it rests on.
Facts are known by a digest of their text, such as ``anc["1","5"]``. Steps are the joins of the
rules' bodies over the finished model, one a rule; what is asked of them afterwards goes over
that table in rounds, one for each level of a proof.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Atom, Rule, Var, bindings
from lodestar.plans.strata import relevant, stratify
from lodestar.sources.tables import Parts, drop, settle

COUNT = "decimal(38,0)"


def text_of(a: Atom, values: list[Column]) -> Column:
    """A fact's text: predicate and arguments as a JSON array."""
    args = F.to_json(F.array(*(v.cast("string") for v in values))) if values else F.lit("[]")
    return F.concat(F.lit("~" * a.negated + a.predicate), args)


def _fact(a: Atom) -> Column:
    return text_of(a, [F.col(x.name) if isinstance(x, Var) else F.lit(x) for x in a.args])


@dataclass
class Proofs:
    """``steps``: ``step, fact, text, rule, parents, absent``; ``given``: ``fact, text`` of facts that need no rule."""

    base: Base
    steps: DataFrame
    given: DataFrame

    def heights(self, by_step: bool = False) -> DataFrame:
        """``fact, height``: the least height of a proof of every fact, given ones having 0.

        With ``by_step``, ``fact, height, step``: every step that ends such a proof, null for given facts.

        In each round the steps all of whose parents are known give their facts. A step goes on
        to the next round with the parents it still lacks, unless its fact is known by then.
        """
        found = Parts(self.steps.sparkSession, "heights")
        new = found.add(self.given.select("fact", F.lit(0).alias("height"), F.lit(None).cast("string").alias("step")).distinct())
        lacking, before = self.steps.select("step", "fact", F.array_distinct("parents").alias("parents")), None
        for height in count(1):
            known = new.select(F.col("fact").alias("parent"), F.lit(True).alias("known")).distinct()
            useful = lacking.join(new.select("fact"), "fact", "left_anti")
            each = useful.select("step", "fact", F.explode("parents").alias("parent")).join(known, "parent", "left")
            # A body has few atoms, so what a step lacks is a short array.
            turn = each.groupBy("step", "fact").agg(F.collect_list(F.when(F.col("known").isNull(), F.col("parent"))).alias("parents"))
            turn = settle(turn.withColumn("lacks", F.size("parents")), "lacking")
            if before is not None:
                drop(before)
            new = found.add(turn.where("lacks = 0").select("fact", F.lit(height).alias("height"), "step"))
            if new.isEmpty():
                break
            lacking, before = turn.where("lacks > 0").select("step", "fact", "parents"), turn
        drop(turn)
        return found.all() if by_step else found.all().select("fact", "height").distinct()

    def least(self) -> DataFrame:
        """``fact, text, height, step, rule, parents``: of every fact a proof's last step of least height, the first in order.

        Every parent's height is less, so going on from parents to their least steps ends at given facts.
        """
        told = self.steps.join(self.heights(by_step=True).select("step", "height"), "step")
        best = F.min_by(F.struct("step", "rule", "parents", "text"), F.struct("rule", "parents"))
        chosen = told.groupBy("fact", "height").agg(best.alias("s"))
        return settle(chosen.select("fact", "s.text", "height", "s.step", "s.rule", "s.parents"), "least")

    def trees(self, goal: Atom) -> DataFrame:
        """``root, fact, text, height, rule, parents``: the facts of a least proof of every fact that matches the goal.

        ``root`` is the goal's fact; given facts have height 0, no rule and no parents. A fact
        that a proof rests on in several places is listed once.
        """
        least = self.least()
        from lodestar.plans.rules import matches

        names = tuple(Var(f"A{i}") for i in range(len(goal.args)))
        rows = matches(self.base.relation(goal.key), Atom(goal.predicate, names, goal.negated))
        for x, name in zip(goal.args, names, strict=True):
            rows = rows.where(F.col(name.name) == F.lit(x)) if not isinstance(x, Var) else rows
        for i, x in enumerate(goal.args):
            for j in range(i):
                if isinstance(x, Var) and x != ANY and goal.args[j] == x:
                    rows = rows.where(F.col(names[i].name) == F.col(names[j].name))
        roots = rows.select(F.md5(_fact(Atom(goal.predicate, names, goal.negated))).alias("root")).distinct()
        # From a fact to those it rests on that aren't given, and the rounds until all that lead there are through.
        lower = least.select(F.col("fact").alias("parent"), F.col("height").alias("lower"))
        below = least.select("fact", "height", F.explode(F.array_distinct("parents")).alias("parent")).join(lower, "parent")
        below = settle(below.select("fact", "parent", (F.col("height") - 1 - F.col("lower")).alias("wait")), "below")
        spark = self.steps.sparkSession
        met = Parts(spark, "met")
        roots = settle(roots, "roots")
        new = met.add(roots.join(least, roots["root"] == least["fact"]).select("root", "fact", F.lit(0).alias("wait")))
        # A fact goes on when its height comes, so once in every tree, and no round looks at what is found.
        while not new.isEmpty():
            on = new.where("wait = 0").select("root", "fact").join(below, "fact").select("root", F.col("parent").alias("fact"), "wait")
            waiting = new.where("wait > 0").select("root", "fact", (F.col("wait") - 1).alias("wait"))
            new = met.add(on.union(waiting).distinct())
        kept = Parts(spark, "trees")
        inner = met.all().where("wait = 0").select("root", "fact").join(least, "fact")
        inner = kept.add(inner.select("root", "fact", "text", "height", "rule", "parents"))
        ends = inner.select("root", F.explode("parents").alias("fact")).union(roots.select("root", F.col("root").alias("fact"))).distinct()
        kept.add(ends.join(self.given, "fact").select(
            "root", "fact", "text", F.lit(0).alias("height"), F.lit(None).cast("int").alias("rule"), F.array().cast("array<string>").alias("parents")
        ))
        for table in (below, roots, met.all()):
            drop(table)
        return kept.all()

    def counts(self, max_height: int | None = None) -> DataFrame:
        """``fact, height, proofs``: how many proofs of every height a fact has, given facts one of height 0.

        A proof is a tree, so a fact used twice is proved twice. Over facts that rest on
        themselves proofs are without end; ``max_height`` bounds them, and is needed there.
        """
        spark = self.steps.sparkSession
        given = self.given.select("fact").distinct()
        total = settle(given.select("fact", F.lit(1).cast(COUNT).alias("proofs")), "proofs")
        out = Parts(spark, "proof-counts")
        out.add(total.select("fact", F.lit(0).alias("height"), "proofs"))
        parents = settle(self.steps.select("step", "fact", F.posexplode("parents").alias("place", "parent")), "parents")
        size = settle(self.steps.select("step", F.size("parents").alias("n")), "sizes")
        for height in count(1) if max_height is None else range(1, max_height + 1):
            # A body has few atoms, so a step's numbers are multiplied as a short array.
            held = parents.join(total.toDF("parent", "of"), "parent").groupBy("step", "fact").agg(F.collect_list("of").alias("all"))
            whole = held.join(size, "step").where("size(all) = n")
            product = F.aggregate("all", F.lit(1).cast(COUNT), lambda s, x: (s * x).cast(COUNT))
            ways = whole.select("fact", product.alias("proofs")).union(given.select("fact", F.lit(1).cast(COUNT)))
            after = settle(ways.groupBy("fact").agg(F.sum("proofs").cast(COUNT).alias("proofs")), "proofs")
            more = after.join(total.toDF("fact", "before"), "fact", "left").select(
                "fact", F.lit(height).alias("height"), (F.col("proofs") - F.coalesce("before", F.lit(0))).cast(COUNT).alias("proofs")
            )
            new = out.add(more.where("proofs > 0"))
            drop(total)
            total = after
            if new.isEmpty():
                break
        return out.all()


def proofs(base: Base, rules: list[Rule], goal: Atom | None = None) -> Proofs:
    """All steps of rules over the model; with a goal, of the rules that it depends on.

    Rules need strata and heads that don't sum up. An absent atom is part of a step as the
    pattern that nothing matched (``absent``), null where it is free.
    """
    own = relevant(goal.key, rules) if goal is not None else list(rules)
    if not stratify(own).stratified or any(r.aggregates for r in own):
        raise ValueError("proofs need rules with strata and without heads that sum up")
    model = base.derive(own).base
    parts = []
    for number, r in enumerate(own):
        if any(not a.absent and a.key not in model.relations for a in r.body):
            continue
        # What is open in a positive atom is one of the facts it rests on.
        body = tuple(
            a if a.absent else replace(a, args=tuple(Var(f"_open{i}_{j}") if x == ANY else x for j, x in enumerate(a.args)))
            for i, a in enumerate(r.body)
        )
        found = bindings(body, lambda a, _: model.relation((a.predicate, len(a.args), False) if a.absent else a.key), tests=r.tests)
        bound = {v for a in body if not a.absent for v in a.variables}
        missing = [
            text_of(a, [F.lit(None) if isinstance(x, Var) and x.name not in bound else F.col(x.name) if isinstance(x, Var) else F.lit(x) for x in a.args])
            for a in body
            if a.absent
        ]
        text = _fact(r.head)
        rows = found.select(
            F.md5(text).alias("fact"),
            text.alias("text"),
            F.lit(number).alias("rule"),
            F.array(*(F.md5(_fact(a)) for a in body if not a.absent)).alias("parents"),
            (F.array(*missing) if missing else F.array().cast("array<string>")).alias("absent"),
        )
        parts.append(rows)
    wanted = {a.key for r in own for a in (r.head, *r.body) if not a.absent} | ({goal.key} if goal is not None else set())
    # By keys, as relations that are only declared would be opened by going through them.
    held = [(key, base.relations[key]) for key in base.relations if key in wanted]
    given = [df.select(text_of(Atom(p, (), neg), [F.col(c) for c in df.columns]).alias("text")) for (p, _, neg), df in held]
    spark = base.spark
    empty = spark.createDataFrame([], "fact string, text string, rule int, parents array<string>, absent array<string>")
    # A step's number, text and absent atoms follow from its fact, rule and parents, so whole rows differ as steps do.
    steps = (reduce(DataFrame.union, parts) if parts else empty).distinct()
    steps = steps.select(F.md5(F.concat_ws(" ", "fact", F.col("rule").cast("string"), F.array_join("parents", " "))).alias("step"), "*")
    known = (reduce(DataFrame.union, given) if given else spark.createDataFrame([], "text string")).distinct()
    return Proofs(model, settle(steps, "steps"), settle(known.select(F.md5("text").alias("fact"), "text"), "given"))


def counted(base: Base, rules: list[Rule], goal: Atom, max_height: int | None = None) -> DataFrame:
    """The goal's ``a1 .. ak`` with ``height, proofs``: what ``Proofs.counts`` says of its predicate, without a table of steps.

    Facts stay rows of their own values. A proof of a height has a part whose height is one
    less, so each round joins only the proofs that the last one found: at one place those of
    that height, before it lower ones, after it all so far. Given facts that no rule derives
    are joined as they are. ``max_height`` is needed where facts rest on themselves.
    """
    own = relevant(goal.key, rules)
    if not stratify(own).stratified or any(r.aggregates for r in own):
        raise ValueError("proofs need rules with strata and without heads that sum up")
    heads = {r.head.key for r in own}
    model = base.derive(own).base if any(a.absent for r in own for a in r.body) else base
    given = {key: df.distinct() for key, df in base.relations.items() if key in heads | {a.key for r in own for a in r.body if not a.absent} | {goal.key}}
    held: dict[tuple, Parts] = {}

    def add(key: tuple, rows: DataFrame, height: int) -> bool:
        kept = held.setdefault(key, Parts(base.spark, "counted"))
        if kept.schema is not None:
            rows = rows.select(*(F.col(c).cast(f.dataType).alias(c) for c, f in zip(rows.columns, kept.schema, strict=False)))
        new = not kept.add(rows.withColumn("height", F.lit(height))).isEmpty()
        if not new:
            kept.forget_last()
        return new

    def found(r: Rule, bounds: dict[int, Column]) -> DataFrame | None:
        """Heads and proofs of a rule, a derived atom at a place having heights within its bounds."""
        body = [a if a.absent else replace(a, args=tuple(Var(f"_open{i}_{j}") if x == ANY else x for j, x in enumerate(a.args))) for i, a in enumerate(r.body)]
        places = {i: f"_proofs{i}" for i in bounds}
        if any(not a.absent and a.key not in (held if i in places else given) for i, a in enumerate(body)):
            return None

        def rows(a: Atom, i: int) -> DataFrame:
            if a.absent:
                return model.relation((a.predicate, len(a.args), False))
            return held[a.key].all().where(bounds[i]).drop("height") if i in places else given[a.key]

        # The number of proofs is one more argument of a derived atom.
        wide = tuple(replace(a, args=(*a.args, Var(places[i]))) if i in places else a for i, a in enumerate(body))
        lookup = lambda a, i: rows(body[i], i)
        product = reduce(lambda x, y: (x * y).cast(COUNT), (F.col(c) for c in places.values()), F.lit(1).cast(COUNT))
        head = [(F.col(x.name) if isinstance(x, Var) else F.lit(x)).alias(f"a{j + 1}") for j, x in enumerate(r.head.args)]
        return bindings(wide, lookup, tests=r.tests).select(*head, product.alias("proofs"))

    for key in heads & set(given) | ({goal.key} & set(given)):
        add(key, given[key].withColumn("proofs", F.lit(1).cast(COUNT)), 0)
    for height in count(1) if max_height is None else range(1, max_height + 1):
        ways: dict[tuple, list[DataFrame]] = {}
        for r in own:
            derived = [i for i, a in enumerate(r.body) if not a.absent and a.key in heads]
            turns = [{i: F.col("height") == 0 for i in derived}] if height == 1 else []
            if height > 1:
                for place in derived:
                    turns.append({i: F.col("height") == height - 1 if i == place else F.col("height") < height - (i < place) for i in derived})
            for turn in turns:
                if (rows := found(r, turn)) is not None:
                    ways.setdefault(r.head.key, []).append(rows)
        more = False
        for key, parts in ways.items():
            rows = reduce(DataFrame.union, parts)
            names = [c for c in rows.columns if c != "proofs"]
            more |= add(key, rows.groupBy(*names).agg(F.sum("proofs").cast(COUNT).alias("proofs")), height)
        if not more:
            break
    return held[goal.key].all() if goal.key in held else base.relation(goal.key).limit(0).withColumns({"proofs": F.lit(0).cast(COUNT), "height": F.lit(0)})
