"""Rules against a plain evaluator, strata, goals, checks and reports."""

import itertools
import random

import pytest

from lodestar.operators import consistency
from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Var, absent, atom, bindings, denied, rule
from lodestar.plans.strata import relevant, stratify

X, Y, Z, W = (Var(v) for v in "XYZW")


def plain(facts, rules):
    """A plain evaluator of stratified rules over sets of tuples."""
    known = {k: set(v) for k, v in facts.items()}
    levels = stratify(rules).levels
    for level in sorted(set(levels.values())):
        own = [r for r in rules if levels[r.head.key] == level]
        while True:
            new = set()
            for r in own:
                rows = [{}]
                for a in sorted(r.body, key=lambda a: a.absent):
                    out = []
                    for b in rows:
                        hits = []
                        for row in known.get(a.predicate, ()):
                            c, fine = dict(b), len(row) == len(a.args)
                            for x, v in zip(a.args, row, strict=False):
                                if x == ANY:
                                    continue
                                fine &= (c.setdefault(x.name, v) if isinstance(x, Var) else x) == v
                            if fine:
                                hits.append(c)
                        out += ([] if hits else [b]) if a.absent else hits
                    rows = out
                new |= {(r.head.predicate, tuple(b[x.name] if isinstance(x, Var) else x for x in r.head.args)) for b in rows}
            fresh = {(p, t) for p, t in new if t not in known.get(p, ())}
            if not fresh:
                break
            for p, t in fresh:
                known.setdefault(p, set()).add(t)
    return known


def base_of(spark, facts):
    base = Base(spark)
    for p, rows in facts.items():
        if rows:
            base.insert(p, sorted(rows))
    return base


def rows(base, predicate, n):
    return {tuple(r) for r in base.relation((predicate, n, False)).collect()}


PROGRAMS = {
    "linear": [rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("e", X, Y), atom("t", Y, Z))],
    "pairs": [rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("t", X, Y), atom("t", Y, Z))],
    "mutual": [
        rule(atom("odd", X, Y), atom("e", X, Y)),
        rule(atom("even", X, Z), atom("odd", X, Y), atom("e", Y, Z)),
        rule(atom("odd", X, Z), atom("even", X, Y), atom("e", Y, Z)),
        rule(atom("t", X, Y), atom("even", X, Y), absent("odd", X, Y)),
    ],
    "symmetric": [rule(atom("e", Y, X), atom("e", X, Y)), rule(atom("t", X, "end"), atom("e", X, X))],
    "absence": [
        rule(atom("t", X, Y), atom("e", X, Y), absent("e", Y, ANY), absent("m", X)),
        rule(atom("alone", X), atom("m", X), absent("e", X, Y), absent("t", ANY, X)),
        rule(atom("none", X), atom("m", X), absent("nothing", ANY)),
        rule(atom("self", X), atom("m", X), absent("e", W, W)),
    ],
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_programs_equal_the_plain_evaluator(spark, name):
    rng = random.Random(len(name))
    for n in (6, 9):
        facts = {"e": {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n)}, "m": {(f"n{i}",) for i in range(0, n, 2)}}
        want = plain(facts, PROGRAMS[name])
        base = base_of(spark, facts)
        for naive in (False, True):
            run = base.derive(PROGRAMS[name], naive=naive)
            assert run.fixpoint
            for head in {r.head.key for r in PROGRAMS[name]}:
                assert rows(run.base, head[0], head[1]) == want.get(head[0], set()), head
        assert rows(base, "e", 2) == facts["e"]  # the base stays as it is


def test_goals_equal_the_fixpoint(spark):
    rng = random.Random(4)
    facts = {"e": {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)}, "t": {("n0", "extra")}}
    base = base_of(spark, facts)
    for name in ("linear", "pairs"):
        want = plain(facts, PROGRAMS[name])["t"]
        for a, b in itertools.product(("n0", "n3", None), ("n1", None)):
            goal = atom("t", a or X, b or Y)
            got = {tuple(r) for r in base.answers(goal, PROGRAMS[name]).collect()}
            hits = [(x, y) for x, y in want if a in (None, x) and b in (None, y)]
            if goal.variables:
                assert got == {tuple(v for v, bound in zip(h, (a, b), strict=True) if bound is None) for h in hits}
            else:
                assert bool(got) == bool(hits)


def test_depths_are_those_of_shortest_proofs(spark):
    base = base_of(spark, {"e": {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")}})
    found = {(r.X, r.Y): r.depth for r in base.prove(atom("t", X, Y), PROGRAMS["linear"]).collect()}
    assert found == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("a", "c"): 1, ("b", "d"): 2, ("a", "d"): 2}
    shallow = base.prove(atom("t", "b", Y), PROGRAMS["linear"], max_depth=1)
    assert {(r.Y, r.depth, r.similarity) for r in shallow.collect()} == {("c", 1, 1.0)}
    assert base.prove(atom("loop", X), [rule(atom("loop", X), atom("loop", X))]).collect() == []


def test_small_programs(spark):
    base = base_of(spark, {"person": {("alice",), ("bob",)}, "enemy": {("alice", "bob")}})
    run = base.derive([rule(atom("human", X), atom("person", X))])
    assert (run.derived, run.rounds, run.per_round, run.fixpoint) == (2, 1, [2, 0], True)
    assert base.derive([]).derived == 0
    assert base.derive([rule(atom("animal", X), atom("dog", X))]).derived == 0
    pairs = base.derive([rule(atom("friendly", X, Y), atom("person", X), atom("person", Y), absent("enemy", X, Y))])
    assert len(rows(pairs.base, "friendly", 2)) == 3
    again = run.base.derive([rule(atom("human", X), atom("person", X))])
    assert again.derived == 0
    chain = base_of(spark, {"e": {(f"p{i}", f"p{i + 1}") for i in range(8)}})
    assert chain.derive(PROGRAMS["linear"]).derived == 36
    capped = chain.derive(PROGRAMS["linear"], max_rounds=2)
    assert not capped.fixpoint and capped.rounds == 2


def test_unsafe_and_unstratified_rules(spark):
    with pytest.raises(ValueError, match="unsafe"):
        rule(atom("p", X), atom("q", Y))
    with pytest.raises(ValueError, match="unsafe"):
        rule(atom("p", X), absent("q", X))
    loop = [rule(atom("p", X), atom("m", X), absent("q", X)), rule(atom("q", X), atom("m", X), absent("p", X))]
    assert not stratify(loop).stratified and "cycle" in stratify(loop).summary()
    hidden = [rule(atom("a", X), atom("b", X)), rule(atom("b", X), atom("a", X)), rule(atom("a", X), atom("m", X), absent("c", X)), rule(atom("c", X), atom("b", X))]
    assert not stratify(hidden).stratified
    with pytest.warns(UserWarning, match="not stratified"):
        base_of(spark, {"m": {("a",)}}).derive(loop, max_rounds=3)
    fine = stratify(PROGRAMS["mutual"])
    assert fine.stratified and fine.levels["t", 2, False] == fine.levels["odd", 2, False] + 1
    assert len(relevant(("odd", 2, False), PROGRAMS["mutual"])) == 3


def test_queries_scores_and_types(spark):
    base = base_of(spark, {"parent": {("alice", "bob"), ("alice", "charlie"), ("bob", "david")}})
    found = base.query(atom("parent", X, Y)).collect()
    assert len(found) == 3 and abs(found[0].score - 0.8155) < 1e-4
    assert [r.X for r in base.query(atom("parent", "alice", X), k=1).collect()] == ["bob"]
    assert base.query(atom("nobody", X)).collect() == [] and base.ask(atom("parent", "bob", "eve")).collect() == []
    assert base.query(denied("parent", X, Y)).collect() == []
    assert {(r.position, r.value) for r in base.query_positions(atom("parent", X, Y), 1).collect()} == {(1, "alice"), (2, "bob")}
    scored = bindings((atom("parent", X, Y), atom("parent", Y, Z)), lambda a, _: base.relation(a.key), scored=True).collect()
    assert [(r.X, r.Z) for r in scored] == [("alice", "david")] and abs(scored[0].score - 0.92388) < 1e-5
    with pytest.raises(TypeError):
        base.register("parent", spark.createDataFrame([(1, 2)], "a long, b long"))


def test_catalogue_and_consistency(spark):
    base = base_of(spark, {"p": {("a", "b"), ("c", "d")}, "q": {("x",)}})
    base.insert("p", [("a", "b"), ("e", "f")], negated=True)
    assert base.predicates() == ["p", "q", "~p"]
    assert {(r.predicate, r.facts) for r in base.stats().collect()} == {("p", 2), ("~p", 2), ("q", 1), (None, 5)}
    report = consistency.check(base)
    assert not report.consistent and report.counts == {("p", 2): 1} and report.facts == 5
    assert consistency.has_contradiction(base, "p", ("a", "b")) and not consistency.has_contradiction(base, "p", ("c", "d"))
    for strategy in consistency.KEEP:
        assert consistency.check(consistency.enforce(base, strategy)).consistent
    with pytest.raises(ValueError):
        consistency.enforce(base, "guess")
    assert base.clear("p").predicates() == ["q"] and base.clear().predicates() == []
