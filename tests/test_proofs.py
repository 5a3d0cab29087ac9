"""Proofs, values and answer tables against plain recursion."""

import itertools
import random
from collections import Counter
from functools import cache

import pytest

from lodestar.plans import annotated, tabling
from lodestar.plans.annotated import PRODUCT, SHORTEST, WEAKEST, best_values
from lodestar.plans.base import Base
from lodestar.plans.proofs import proofs
from lodestar.plans.rules import ANY, Var, absent, atom, rule

X, Y, Z = (Var(v) for v in "XYZ")
PATHS = [rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("t", X, Y), atom("e", Y, Z))]
PAIRED = [rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("t", X, Y), atom("t", Y, Z))]


def test_counts_heights_and_least_proofs_on_a_small_dag(spark):
    edges = [(i, i + 1) for i in range(5)] + [(i, i + 2) for i in range(4)]
    base = Base(spark).insert("e", edges)

    @cache
    def ways(a, b):
        """Counter of heights of the proofs of t(a, b) by pairs of t."""
        found = Counter({1: 1} if (a, b) in edges else {})
        for m in range(a + 1, b):
            for (h, n), (g, k) in itertools.product(ways(a, m).items(), ways(m, b).items()):
                found[1 + max(h, g)] += n * k
        return found

    made = proofs(base, PAIRED, atom("t", X, Y))
    names = {r.fact: r.text for r in made.steps.select("fact", "text").distinct().collect()}
    counted = {(names[r.fact], r.height): int(r.proofs) for r in made.counts().collect() if r.fact in names}
    want = {(f't["{a}","{b}"]', h): n for a in range(6) for b in range(a + 1, 6) for h, n in ways(a, b).items()}
    assert counted == want
    heights = {names[r.fact]: r.height for r in made.heights().collect() if r.fact in names}
    assert heights == {f't["{a}","{b}"]': min(ways(a, b)) for a in range(6) for b in range(a + 1, 6)}
    trees = made.trees(atom("t", "0", Y)).collect()
    own = {(r.root, r.fact): r for r in trees}
    for r in trees:
        if r.rule is None:
            assert r.text.startswith("e[") and r.height == 0
        else:
            below = [own[r.root, p] for p in r.parents]  # every parent is in the tree, and lower
            assert r.height == 1 + max(b.height for b in below)
    assert {names[r.root] for r in trees} == {f't["0","{b}"]' for b in range(1, 6)}


def test_steps_with_absence_open_places_and_cycles(spark):
    base = Base(spark).insert("e", [("a", "b"), ("b", "a"), ("b", "c")]).insert("bad", [("a",)]).insert("t", [("b", "c")])
    rules = [*PATHS, rule(atom("ok", X), atom("t", X, ANY), absent("bad", X))]
    made = proofs(base, rules, atom("ok", X))
    steps = {(r.text, tuple(r.absent)) for r in made.steps.where("text like 'ok%'").collect()}
    assert steps == {('ok["b"]', ('bad["b"]',))}
    assert made.steps.where("text like 'ok%'").count() == 3  # for each of t(b, _)
    counted = made.counts(3).groupBy("fact").sum("proofs").collect()
    assert all(r[1] > 0 for r in counted)
    tree = made.trees(atom("ok", X)).collect()
    assert {r.text for r in tree if r.height == 0} == {'t["b","c"]'}  # given, so it needs no proof
    with pytest.raises(ValueError):
        proofs(base, [rule(atom("w", X), atom("e", X, Y), absent("w", Y))])


def best(edges, times, pick):
    found = dict(edges)
    while True:
        new = {}
        for ((a, b), v), ((c, d), w) in itertools.product(found.items(), edges.items()):
            if b == c:
                new[a, d] = pick(new.get((a, d), times(v, w)), times(v, w))
        merged = {k: pick(found.get(k, new.get(k)), new.get(k, found.get(k))) for k in found | new}
        if merged == found:
            return found
        found = merged


def test_best_values_with_cycles(spark, monkeypatch):
    monkeypatch.setattr(annotated, "MOST_PARTS", 2)
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}"): rng.choice([0.5, 0.25, 0.75, 1.0]) for _ in range(14)}
    rows = spark.createDataFrame([(*k, v) for k, v in edges.items()] + [(*k, v / 2) for k, v in list(edges.items())[:3]], "x string, y string, sure double")
    for algebra, times, pick in ((PRODUCT, lambda x, y: x * y, max), (WEAKEST, min, max), (SHORTEST, lambda x, y: x + y, min)):
        given = edges if pick is max else {k: v / 2 if i < 3 else v for i, (k, v) in enumerate(edges.items())}
        for rules in (PATHS, PAIRED):
            found = best_values(Base(spark), rules, {"e": rows}, algebra).query(atom("t", X, Y)).collect()
            assert {(r.X, r.Y): round(r.value, 9) for r in found} == {k: round(v, 9) for k, v in best(given, times, pick).items()}
    run = best_values(Base(spark).insert("n", [("n0",)]), [*PATHS, rule(atom("u", Y), atom("n", X), atom("t", X, Y), absent("n", Y))], {"e": rows}, PRODUCT)
    want = {b: v for (a, b), v in best(edges, lambda x, y: x * y, max).items() if a == "n0" and b != "n0"}
    assert {r.Y: round(r.value, 9) for r in run.query(atom("u", Y)).collect()} == {k: round(v, 9) for k, v in want.items()}
    top = run.query(atom("t", X, Y), 3).collect()
    assert len(top) == 3 and top[0].value == max(best(edges, lambda x, y: x * y, max).values())
    for bad in (1.5, None, -0.1):
        wrong = spark.createDataFrame([("a", "b", bad)], "x string, y string, w double")
        with pytest.raises(Exception, match="weight"):
            best_values(Base(spark), PATHS, {"e": wrong}, PRODUCT)


def test_answer_tables(spark):
    base = Base(spark).insert("e", [(str(i), str(i + 1)) for i in range(5)]).insert("other", [("x",)])
    tables = tabling.Tabled(base, PATHS)
    assert sorted(r.Y for r in tables.answers(atom("t", "1", Y)).collect()) == ["2", "3", "4", "5"]
    assert tables.stats() == {"tables": 1, "hits": 0, "misses": 1}
    derive, Base.derive = Base.derive, None  # no round may run now
    try:
        assert tables.answers(atom("t", "1", "4")).count() == 1 and tables.answers(atom("t", "1", "0")).count() == 0
        assert tables.answers(atom("t", "1", Z)).columns == ["Z"]
    finally:
        Base.derive = derive
    assert tables.stats() == {"tables": 1, "hits": 3, "misses": 1}
    base.insert("other", [("y",)])  # no goal depends on it
    tables.answers(atom("t", "1", "5"))
    assert tables.hits == 4
    base.insert("e", [("5", "6")])
    assert tables.answers(atom("t", "1", Y)).count() == 5 and tables.stats() == {"tables": 1, "hits": 4, "misses": 2}
    tables.answers(atom("t", X, X))
    assert tables.misses == 3 and len(tables.tables) == 2
    tables.clear("other")
    assert len(tables.tables) == 2
    tables.clear()
    assert tables.stats()["tables"] == 0


def test_what_covers_what():
    assert tabling.covers(atom("t", X, Y), atom("t", "a", Z)) and tabling.covers(atom("t", X, X), atom("t", "a", "a"))
    assert tabling.covers(atom("t", X, ANY), atom("t", X, "b")) and tabling.covers(atom("t", X, Y), atom("t", ANY, ANY))
    for general, narrow in ((("a", X), (X, "b")), ((X, X), ("a", "b")), ((X, X), (ANY, ANY)), ((X, X), (X, Y)), ((1, X), ("1", X)), ((True, X), (1, X))):
        assert not tabling.covers(atom("t", *general), atom("t", *narrow)), (general, narrow)
    assert not tabling.covers(atom("t", X), atom("u", X))


def test_counted_facts_equal_counts_of_steps(spark):
    from lodestar.plans.proofs import counted

    edges = [(i, i + 1) for i in range(5)] + [(i, i + 2) for i in range(4)]
    base = Base(spark).insert("e", [*edges, (0, 1)]).insert("t", [(1, 2), (0, 5)]).insert("bad", [("3",)])
    for rules in (PATHS, PAIRED, [*PATHS, rule(atom("t", X, Y), atom("t", X, Y), atom("e", X, ANY), absent("bad", Y))][:2] + [rule(atom("t", X, X), atom("e", X, ANY), absent("bad", X))]):
        made = proofs(base, rules, atom("t", X, Y))
        most = 4 if len(rules) > 2 else None  # facts that rest on themselves
        names = {r.fact: r.text for r in made.steps.select("fact", "text").union(made.given.select("fact", "text")).collect()}
        want = {(names[r.fact], r.height): int(r.proofs) for r in made.counts(most).collect() if names[r.fact].startswith("t[")}
        found = {(f't["{r.a1}","{r.a2}"]', r.height): int(r.proofs) for r in counted(base, rules, atom("t", X, Y), most).collect()}
        assert found == want and len(want) > 10


def test_counting_proofs_writes_no_steps(spark, monkeypatch):
    from lodestar import model_queries
    from lodestar.plans import proofs as module

    monkeypatch.setattr(module, "proofs", None)
    assert model_queries.proof_counts(spark, "/root/testdata/sf0.001").count() > 10


def test_trees_and_heights_of_odd_programs_equal_plain_walks(spark):
    """Facts met at several depths of a tree, given facts that have steps, cycles, repeated and null arguments."""
    rng = random.Random(5)
    edges = [(str(a), str(rng.randrange(a + 1, min(a + 5, 13)))) for a in range(12) for _ in range(2)]
    rows = spark.createDataFrame([*edges, *edges[:3], ("3", "3"), (None, "4"), ("5", None), (None, None)], "x string, y string")
    for rules, goal in ((PAIRED, atom("t", X, Y)), (PATHS, atom("t", "1", Y)), (PAIRED, atom("t", X, X)), (PATHS, atom("e", X, Y))):
        base = Base(spark).register("e", rows).insert("t", [("2", "9"), ("2", "9"), ("7", "0")])
        made = proofs(base, rules, goal)
        steps, given = made.steps.collect(), {r.fact: r.text for r in made.given.collect()}
        assert len({r.step for r in steps}) == len({(r.fact, r.rule, tuple(r.parents)) for r in steps}) == len(steps) and len(given) == made.given.count()
        height = dict.fromkeys(given, 0)
        for n in itertools.count(1):
            new = {r.fact for r in steps if r.fact not in height and all(p in height for p in r.parents)}
            if not new:
                break
            height |= dict.fromkeys(new, n)
        found = made.heights().collect()
        assert {r.fact: r.height for r in found} == height and len(found) == len(height)
        last = {}
        for r in steps:
            if all(p in height for p in r.parents) and height[r.fact] == 1 + max(height[p] for p in r.parents):
                last[r.fact] = min(last.get(r.fact, (r.rule, r.parents, r.text)), (r.rule, r.parents, r.text))
        assert {r.fact: (r.rule, r.parents, r.text) for r in made.least().collect()} == last
        name = lambda a: a.predicate + "[" + ",".join("null" if x is None else f'"{x}"' for x in a.args) + "]"
        model = {tuple(r) for r in made.base.relation(goal.key).collect()}
        asked = {name(atom(goal.predicate, *r)) for r in model if all(isinstance(g, Var) or g == v for g, v in zip(goal.args, r, strict=True))}
        asked -= {name(atom(goal.predicate, *r)) for r in model if goal.args[0] == goal.args[1] and (r[0] != r[1] or r[0] is None)}
        texts = {**given, **{f: v[2] for f, v in last.items()}}
        want = set()
        for root in (f for f in height if texts[f] in asked):
            todo = [root]
            while todo:
                fact = todo.pop()
                rule_, parents, _ = last.get(fact, (None, [], None))
                if (row := (root, fact, texts[fact], height[fact], rule_, tuple(parents))) not in want:
                    want.add(row)
                    todo += parents
        trees = [(r.root, r.fact, r.text, r.height, r.rule, tuple(r.parents)) for r in made.trees(goal).collect()]
        assert len(trees) == len(want) and set(trees) == want and want


def test_rounds_of_a_tree_read_no_earlier_round(spark, monkeypatch):
    """However long the chains are, the parts of all rounds are read as a whole as often."""
    from lodestar.plans import proofs as module

    def whole_reads(n):
        made = proofs(Base(spark).insert("e", [(i, i + 1) for i in range(n)]), PATHS, atom("t", X, Y))
        seen, plain = [], module.Parts.all
        with monkeypatch.context() as m:
            m.setattr(module.Parts, "all", lambda self: (seen.append(self.base), plain(self))[1])
            assert made.trees(atom("t", X, Y)).count() == sum((n - k) * (2 * k + 2) for k in range(n))
        return len(seen)

    assert whole_reads(3) == whole_reads(6)


def test_proof_least_goes_over_the_trees_once(spark):
    from lodestar import model_queries

    plan = model_queries.proof_least(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_proofs_open_only_relations_that_rules_name(spark):
    def opened():
        raise AssertionError("opened")

    base = Base(spark).declare("other", ["x", "y"], opened).insert("e", [("a", "b"), ("b", "c")])
    made = proofs(base, PATHS, atom("t", X, Y))
    assert {r.text for r in made.given.collect()} == {'e["a","b"]', 'e["b","c"]'} and made.trees(atom("t", X, Y)).count() == 8
