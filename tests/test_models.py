"""Undefined rows, demand through absence, totals and comparisons against plain evaluation."""

import itertools
import random
import warnings
from datetime import date, datetime, timedelta

import pytest

from lodestar.operators import bands
from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Var, absent, atom, compare, rule, total, within
from lodestar.plans.wellfounded import well_founded

X, Y, Z, N = (Var(v) for v in "XYZN")
WIN = [rule(atom("win", X), atom("move", X, Y), absent("win", Y))]


def game(moves):
    """Won and open nodes by going back from lost ones."""
    nodes = {n for m in moves for n in m}
    won, lost = set(), set()
    while True:
        more_lost = {n for n in nodes if all(b in won for a, b in moves if a == n)}
        more_won = {a for a, b in moves if b in more_lost}
        if (more_won, more_lost) == (won, lost):
            return won, nodes - won - lost
        won, lost = more_won, more_lost


def test_games_with_and_without_cycles(spark):
    rng = random.Random(2)
    for n in (4, 9):
        moves = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n + 2)}
        won, left = game(moves)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)
            run = Base(spark).insert("move", sorted(moves)).derive(WIN)
        assert {r.a1 for r in run.base.relation(("win", 1, False)).collect()} == won
        undefined = run.undefined.get(("win", 1, False))
        assert ({r.a1 for r in undefined.collect()} if undefined else set()) == left


def test_undefined_rows_pass_on_and_strata_stay(spark):
    loop = [
        rule(atom("p", X), atom("m", X), absent("q", X)),
        rule(atom("q", X), atom("m", X), absent("p", X)),
        rule(atom("q", X), atom("sure", X)),
        rule(atom("r", X), atom("p", X)),
        rule(atom("s", X), atom("m", X), absent("r", X)),
        rule(atom("t", X), atom("m", X), absent("sure", X)),
    ]
    with pytest.warns(UserWarning, match="not stratified"):
        run = Base(spark).insert("m", [("a",), ("b",)]).insert("sure", [("b",)]).derive(loop)
    true = {(k[0], r.a1) for k in run.base.relations for r in run.base.relation(k).collect() if k[0] not in ("m", "sure")}
    undefined = {(k[0], r.a1) for k, rows in run.undefined.items() for r in rows.collect()}
    assert true == {("q", "b"), ("s", "b"), ("t", "a")}
    assert undefined == {("p", "a"), ("q", "a"), ("r", "a"), ("s", "a")}
    layered = [rule(atom("u", X), atom("m", X), absent("sure", X)), rule(atom("v", X), atom("m", X), absent("u", X))]
    model = well_founded(Base(spark).insert("m", [("a",), ("b",)]).insert("sure", [("b",)]), layered)
    assert not model.undefined and [r.a1 for r in model.base.relation(("v", 1, False)).collect()] == ["b"]
    with pytest.raises(ValueError, match="strata"):
        Base(spark).insert("move", [("a", "b")]).prove(atom("win", X), WIN)


APART = [
    rule(atom("anc", X, Y), atom("e", X, Y)),
    rule(atom("anc", X, Z), atom("e", X, Y), atom("anc", Y, Z)),
    rule(atom("apart", X, Y), atom("n", X), atom("n", Y), absent("anc", X, Y), absent("anc", Y, X)),
    rule(atom("lonely", X), atom("n", X), absent("anc", X, ANY), absent("anc", ANY, X)),
    rule(atom("far", X, Z), atom("apart", X, Y), atom("apart", Y, Z), absent("apart", X, Z), absent("lonely", Y)),
]


def test_goals_through_absence_equal_the_whole_model(spark):
    base = Base(spark).insert("e", [(f"{c}{i}", f"{c}{i + 1}") for c in "ab" for i in range(4)])
    base.insert("n", [(f"{c}{i}",) for c in "ab" for i in range(5)] + [("z",)])
    full = base.derive(APART)
    for goal in (atom("apart", "a2", Y), atom("far", "a1", Z), atom("lonely", X), atom("apart", "a1", "b2"), atom("far", "a1", "a3")):
        want = {tuple(r)[:-1] for r in full.base.query(goal).collect()} if goal.variables else bool(full.base.ask(goal).collect())
        got = base.answers(goal, APART).collect()
        assert ({tuple(r) for r in got} if goal.variables else bool(got)) == want, goal
    run, inner = base.demand(atom("apart", "a2", Y), APART)
    assert run.derived < full.derived / 2 and run.base.relation(inner.key).count() == 7  # itself, b0 to b4 and z
    derived = {k[0] for k in run.base.relations}
    assert "apart" not in derived and "anc" not in derived  # only what was asked for, under names of its own


def test_recursion_through_asked_absence_falls_back_to_plain_asking(spark):
    rules = [
        rule(atom("bad", X), atom("b", X)),
        rule(atom("bad", X), atom("e", Y, X), atom("bad", Y), absent("good", X)),
        rule(atom("walk", X, Y), atom("e", X, Y), absent("bad", Y)),
        rule(atom("walk", X, Z), atom("walk", X, Y), atom("e", Y, Z), absent("bad", Z)),
    ]
    base = Base(spark).insert("e", [(str(i), str(j)) for i in range(6) for j in (i + 1, (i * 2) % 6)]).insert("b", [("4",)]).insert("good", [("5",)])
    want = {tuple(r)[:-1] for r in base.derive(rules).base.query(atom("walk", "0", Y)).collect()}
    assert {tuple(r) for r in base.answers(atom("walk", "0", Y), rules).collect()} == want


def test_answers_handed_through_need_no_way_back(spark):
    links = [(str(i), str(j)) for i in range(8) for j in (i + 1, (5 * i) % 8)]
    base = Base(spark).insert("e", links).insert("anc", [("3", "given")]).insert("stop", [("7",)])
    right, left = APART[:2], [APART[0], rule(atom("anc", X, Z), atom("anc", X, Y), atom("e", Y, Z))]
    guarded = [APART[0], rule(atom("anc", X, Z), atom("e", X, Y), atom("anc", Y, Z), absent("stop", Y), compare(Y, "!=", X))]
    named = [APART[0], rule(atom("anc", X, Z), atom("e", X, Y), atom("anc", Y, Z), atom("e", Z, ANY))]  # Z is used elsewhere
    for rules, handed in ((right, True), (left, False), (guarded, True), (named, False)):
        full = base.derive(rules).base
        for goal in (atom("anc", "1", Y), atom("anc", X, "given"), atom("anc", "2", "5")):
            run, inner = base.demand(goal, rules)
            want = {tuple(r)[:-1] for r in full.query(goal).collect()} if goal.variables else bool(full.ask(goal).collect())
            got = run.base.query(inner).collect()
            assert ({tuple(r)[:-1] for r in got} if goal.variables else bool(got)) == want, (goal, handed)
            if goal == atom("anc", "1", Y):
                assert inner.predicate.endswith("answers") == handed


def test_totals(spark):
    rows = [("a", 1, 2.0), ("a", 2, 2.0), ("a", 2, 5.0), ("b", 7, None), ("b", 8, 1.0)]
    base = Base(spark).register("s", spark.createDataFrame(rows, "k string, i int, v double"))
    rules = [
        rule(atom("count", X, total("count", Z)), atom("s", X, ANY, Z)),
        rule(atom("sum", X, total("sum", Z)), atom("s", X, Y, Z)),
        rule(atom("both", X, total("min", Y), "top", total("max", Y)), atom("s", X, Y, ANY)),
        rule(atom("all", total("count", Y)), atom("s", ANY, Y, ANY)),
        rule(atom("many", X), atom("count", X, N), compare(N, ">", 1)),
        rule(atom("none", total("count", X)), atom("s", X, 99, ANY)),
    ]
    run = base.derive(rules).base
    got = {k[0]: sorted(map(tuple, run.relation(k).collect())) for k in run.relations}
    assert got["count"] == [("a", 2), ("b", 1)] and got["sum"] == [("a", 9.0), ("b", 1.0)]
    assert got["both"] == [("a", 1, "top", 2), ("b", 7, "top", 8)] and got["all"] == [(4,)]
    assert got["many"] == [("a",)] and got["none"] == []
    assert [r.N for r in base.answers(atom("count", "a", N), rules).collect()] == [2]
    with pytest.raises(ValueError, match="unsafe"):
        rule(atom("p", total("sum", Y)), atom("q", X))
    with pytest.raises(ValueError):
        total("median", X)
    with pytest.raises(ValueError, match="sums up"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        base.derive([rule(atom("w", X, total("count", Y)), atom("s", X, Y, ANY), absent("w", X, 1))])


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_band_joins_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(bands, "SPLIT", 3)
    whole = [rng.randrange(-50, 50) for _ in range(60)] + [None, 7, 7, 7, 7, 7, 7, 7]
    real = [x if x is None else x * 0.1 for x in whole]
    start = datetime(2024, 1, 1)
    times = [x if x is None else start + timedelta(seconds=x) for x in whole]
    days = [x if x is None else date(2024, 3, 1) + timedelta(days=x) for x in whole]
    cases = [(whole, "bigint", -3, 4), (whole, "bigint", 0, 0), (real, "double", -0.25, 0.3), (real, "double", 0, 0), (whole, "bigint", None, -1), (whole, "bigint", 2, None)]
    cases += [(times, "timestamp", timedelta(seconds=-2), timedelta(seconds=5)), (days, "date", timedelta(0), timedelta(days=2))]
    for values, kind, low, high in cases:
        left = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, a {kind}")
        right = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"j int, b {kind}")
        joined = bands.band_join(left, right, "a", "b", low, high)
        want = [
            (i, a, j, b)
            for (i, a), (j, b) in itertools.product(enumerate(values), repeat=2)
            if a is not None and b is not None and (low is None or b >= a + low) and (high is None or b <= a + high)
        ]
        assert pairs(joined) == sorted(want, key=str), (kind, low, high)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_comparisons_in_bodies(spark):
    base = Base(spark).register("a", spark.range(20).selectExpr("id * 2 AS x")).register("b", spark.range(20).selectExpr("id * 3 AS y"))
    base.insert("w", [("p", "q"), ("q", "p"), ("r", "r")])
    rules = [
        rule(atom("near", X, Y), atom("a", X), atom("b", Y), within(X, Y, 0, 3)),
        rule(atom("less", X, Y), atom("a", X), atom("b", Y), compare(Y, "<", X)),
        rule(atom("even", X, Y), atom("a", X), atom("b", Y), compare(X, "=", Y)),
        rule(atom("order", X, Y), atom("w", X, Y), compare(X, "<", Y)),
        rule(atom("named", X, Y), atom("w", X, ANY), atom("w", ANY, Y), compare(X, ">=", Y), compare(X, "!=", "q")),
    ]
    run = base.derive(rules).base
    got = {k[0]: {tuple(r) for r in run.relation(k).collect()} for k in run.relations}
    every = set(itertools.product(range(0, 40, 2), range(0, 60, 3)))
    assert got["near"] == {(x, y) for x, y in every if 0 <= y - x <= 3} and got["less"] == {(x, y) for x, y in every if y < x}
    assert got["even"] == {(x, y) for x, y in every if y == x} and got["order"] == {("p", "q")}
    assert got["named"] == {(x, y) for x in "pr" for y in "pqr" if x >= y}
    with pytest.raises(ValueError):
        compare(X, "~", Y)


def test_counts_beyond_a_value_make_no_pairs(spark, monkeypatch):
    from lodestar.plans import rules

    rng = random.Random(5)
    values = [*(float(rng.randrange(6)) for _ in range(40)), None, float("nan"), -0.0]
    has = [(rng.randrange(12), v) for v in values]
    of = [(rng.randrange(9) if i % 7 else None, v) for i, v in enumerate(values)]
    base = Base(spark).register("has", spark.createDataFrame(has, "k int, v double")).register("of", spark.createDataFrame(of, "k int, v double"))
    fine = lambda v: v is not None and v == v
    ops = {"<": lambda y, x: y < x, "<=": lambda y, x: y <= x, ">": lambda y, x: y > x, ">=": lambda y, x: y >= x}
    monkeypatch.setattr(rules, "band_join", None)  # no pair may be made
    for op, holds in ops.items():
        pairs = [(k, t) for k, x in has for t, y in of if fine(x) and fine(y) and holds(y, x)]
        want = {(k, len({t for g, t in pairs if g == k and t is not None}), "c") for k in {k for k, _ in pairs}}
        for test in (compare(Y, op, X), compare(X, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op], Y)):
            for body in ((atom("has", Z, X), atom("of", N, Y)), (atom("of", N, Y), atom("has", Z, X))):
                run = base.derive([rule(atom("n", Z, total("count", N), "c"), *body, test)])
                assert sorted(map(tuple, run.base.relation(("n", 3, False)).collect())) == sorted(want)


def test_pairs_of_what_occurs_once_are_not_dealt_out_again(spark):
    rows = [(i, i % 13, i % 5) for i in range(60)]
    soon = rule(atom("soon", X, Y), atom("p", X, Z, ANY), atom("q", Y, N, ANY), within(Z, N, 0, 2))
    for more in ([], [(7, 8, 1), (7, 7, 2)], [(None, 3, 1), (None, 4, 1)]):
        p, q = (spark.createDataFrame(x, "k int, v int, w int") for x in (rows + more, rows))
        found = Base(spark).register("p", p).register("q", q).follows(soon)
        want = {(a, b) for a, v, _ in rows + more for b, w, _ in rows if 0 <= w - v <= 2}
        got = list(map(tuple, found.collect()))
        assert len(got) == len(want) and set(got) == want
        assert ("Aggregate [a1" in found._jdf.queryExecution().optimizedPlan().toString()) == bool(more)
    base = Base(spark).register("p", p).register("q", q)
    with pytest.raises(ValueError):
        base.follows(rule(atom("p", X, Y, Z), atom("p", X, Y, Z)))
