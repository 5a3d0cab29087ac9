"""Streams of inserts and deletes: what follows equals the closure of what is left, after failures at any write too."""

import random

import pytest

from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Var, absent, atom, compare, rule
from lodestar.sources import tables
from lodestar.streaming import ingest
from lodestar.streaming.ingest import LiveBase

X, Y, Z = (Var(v) for v in "XYZ")
RULES = [
    rule(atom("t", X, Y), atom("e", X, Y)),
    rule(atom("t", X, Z), atom("t", X, Y), atom("e", Y, Z)),
    rule(atom("lone", X), atom("n", X), absent("t", ANY, X)),
    rule(atom("pair", X, Y), atom("lone", X), atom("lone", Y), compare(X, "<", Y)),
]
FEED = {"e": "x string, y string"}


def closure(edges, names):
    t = set(edges)
    while new := {(a, d) for a, b in t for c, d in edges if b == c} - t:
        t |= new
    lone = {x for x in names if all(b != x for _, b in t)}
    return t, {(x,) for x in lone}, {(a, b) for a in lone for b in lone if a < b}


def held(live):
    return [{tuple(r) for r in live.base.relation(key).collect()} for key in (("t", 2, False), ("lone", 1, False), ("pair", 2, False))]


def names(spark, n=6):
    return Base(spark).insert("n", [(f"n{i}",) for i in range(n)])


def batch_of(spark, changes):
    return spark.createDataFrame([(*k, d) for k, d in changes.items()], "x string, y string, gone boolean")


def test_inserts_and_deletes_equal_the_closure_of_what_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_FILES", 4)
    rng = random.Random(3)
    live, edges = LiveBase(names(spark), RULES, FEED, f"{tmp_path}/held"), set()
    for step in range(5):
        changes = {(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}"): rng.random() < 0.3 for _ in range(4)}
        changes |= {e: True for e in sorted(edges)[: step % 2 + 1]}
        edges = (edges | {e for e, gone in changes.items() if not gone}) - {e for e, gone in changes.items() if gone}
        live.fold("e", batch_of(spark, changes), "gone")
        assert held(live) == list(closure(edges, [f"n{i}" for i in range(6)])), step
        assert all(len(f) <= 5 for f in live.files.values())
    again = LiveBase(names(spark), RULES, FEED, f"{tmp_path}/held")
    assert held(again) == held(live) and again.version == live.version
    more = LiveBase(names(spark, 7), RULES, FEED, f"{tmp_path}/held")  # other facts: derived anew
    assert held(more) == list(closure(edges, [f"n{i}" for i in range(7)])) and more.version == live.version + 1


def test_a_failure_at_any_write_loses_nothing(spark, tmp_path, monkeypatch):
    rules = [rule(atom("p", X), atom("e", X)), rule(atom("q", X), atom("p", X)), rule(atom("r", X), atom("m", X), absent("q", X))]

    def start():
        return LiveBase(Base(spark).insert("m", [("a",), ("v",)]), rules, {"e": "x string"}, f"{tmp_path}/held")

    def state(live):
        return [sorted(x[0] for x in live.base.relation((k, 1, False)).collect()) for k in "epqr"]

    live = start()
    live.fold("e", spark.createDataFrame([("a",), ("b",)], "x string"))
    plain, commit = tables.write, tables.Ledger.commit
    for batch, want in (([("v", False)], [["a", "b", "v"]] * 3 + [[]]), ([("a", True), ("c", False)], [["b", "c", "v"]] * 3 + [["a"]])):
        rows, before = spark.createDataFrame(batch, "x string, gone boolean"), state(live)
        for at in range(100):
            left = [at]

            def failing(df, path, left=left):
                if not left[0]:
                    raise OSError("lost")
                left[0] -= 1
                plain(df, path)

            def failing_commit(self, version, content, left=left):
                if not left[0]:
                    raise OSError("lost before the rename")
                left[0] -= 1
                commit(self, version, content)

            with monkeypatch.context() as m:
                m.setattr(tables, "write", failing)
                m.setattr(tables.Ledger, "commit", failing_commit)
                try:
                    live.fold("e", rows, "gone")
                    break
                except OSError:
                    pass
            if at % 3 == 0:
                live = start()  # as after a crash of the driver
            if at % 4 == 0:
                assert state(live) == before, at
        assert at > 4 and state(live) == want
        live.fold("e", rows, "gone")  # delivered again after it was folded
        assert state(live) == want and state(start()) == want


def test_streams_restart_and_take_deletes_in_order(spark, tmp_path):
    rules = [rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("t", X, Y), atom("e", Y, Z))]
    schema, folder = "x string, y string, gone boolean, at long", f"{tmp_path}/in"
    live = LiveBase(Base(spark), rules, FEED, f"{tmp_path}/held")
    steps = [
        [("a", "b", False, 1), ("b", "c", False, 2)],
        [("c", "d", False, 3), ("b", "c", True, 5), ("b", "c", False, 4)],
        [("b", "c", False, 6), ("a", "b", True, 7), (None, "a", False, 8)],
    ]
    wanted = ["ab bc ac", "ab cd", "bc cd bd Na"]
    for n, (rows, want) in enumerate(zip(steps, wanted, strict=True)):
        if n == 2:
            live = LiveBase(Base(spark), rules, FEED, f"{tmp_path}/held")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        live.follow(stream, "e", f"{tmp_path}/checkpoint", "gone", "at").awaitTermination()
        got = {"".join(v or "N" for v in r) for r in live.base.relation(("t", 2, False)).collect()}
        assert got == set(want.split()), n
    version = live.version
    live.follow(spark.readStream.schema(schema).parquet(folder), "e", f"{tmp_path}/checkpoint", "gone", "at").awaitTermination()
    assert live.version == version


def test_given_facts_of_derived_predicates_outlive_deletes(spark, tmp_path):
    base = Base(spark).insert("p", [("a",), ("z",)])
    live = LiveBase(base, [rule(atom("p", X), atom("e", X))], {"e": "x string"}, f"{tmp_path}/held")
    live.fold("e", spark.createDataFrame([("a",), ("b",)], "x string"))
    live.fold("e", spark.createDataFrame([("a", True), ("b", True)], "x string, gone boolean"), "gone")
    assert sorted(r.a1 for r in live.base.relation(("p", 1, False)).collect()) == ["a", "z"]


def test_facts_given_with_a_known_folder_are_folded_in(spark, tmp_path):
    rules = [rule(atom("t", X), atom("e", X, Y))]
    live = LiveBase(Base(spark).insert("e", [("a", "b")]), rules, FEED, f"{tmp_path}/held")
    live.fold("e", spark.createDataFrame([("c", "d")], "x string, y string"))
    again = LiveBase(Base(spark).insert("e", [("a", "b"), ("f", "g")]), rules, FEED, f"{tmp_path}/held")
    assert sorted(r.a1 for r in again.base.relation(("t", 1, False)).collect()) == ["a", "c", "f"]


def test_what_a_live_base_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="strata"):
        LiveBase(Base(spark), [rule(atom("w", X), atom("e", X, Y), absent("w", Y))], FEED, f"{tmp_path}/x")
    with pytest.raises(ValueError, match="stream"):
        LiveBase(Base(spark), [rule(atom("e", X, Y), atom("f", X, Y))], FEED, f"{tmp_path}/y")
