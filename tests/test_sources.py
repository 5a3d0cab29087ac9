"""Files of facts, traces, beliefs, vectors and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.functions.scores import joint_score, score
from lodestar.operators import beliefs, consistency, traces, vectors
from lodestar.plans.base import Base
from lodestar.plans.rules import Var, absent, atom, rule
from lodestar.sources import facts, tables

X, Y, Z = (Var(v) for v in "XYZ")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("alice, bob\n\n carol ,dave\nsolo\n")
    named = facts.read_facts(spark, f"{tmp_path}/a.csv", predicate="parent").collect()
    assert sorted(tuple(r.args) for r in named) == [("alice", "bob"), ("carol", "dave"), ("solo",)]
    with pytest.raises(Exception, match="at least 2 columns"):
        facts.read_facts(spark, f"{tmp_path}/a.csv").collect()
    (tmp_path / "b.csv").write_text("parent,alice,bob\nage,alice,7\nperson,zoe\n")
    (tmp_path / "q.csv").write_text('"a, b","say ""hi""" x,,"", plain " quote,last\n')
    assert facts.read_facts(spark, f"{tmp_path}/q.csv", predicate="p").first().args == ["a, b", 'say "hi" x', "", "", 'plain " quote', "last"]
    base = Base(spark).load(facts.read_facts(spark, f"{tmp_path}/b.csv"))
    assert base.has("person") and not base.has("person", negated=True)
    assert base.predicates() == ["age", "parent", "person"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"predicate": "p", "args": ["x", 7]}\n\n{"predicate": "p", "args": [], "negated": true}\n')
    got = facts.read_facts(spark, f"{tmp_path}/a.jsonl").collect()
    assert sorted((r.predicate, tuple(r.args), r.negated) for r in got) == [("p", (), True), ("p", ("x", "7"), False)]
    (tmp_path / "b.jsonl").write_text('{"predicate": "p"}\n')
    with pytest.raises(Exception, match="predicate and args"):
        facts.read_facts(spark, f"{tmp_path}/b.jsonl").collect()
    (tmp_path / "c.jsonl").write_text("{nonsense\n")
    with pytest.raises(Exception):
        facts.read_facts(spark, f"{tmp_path}/c.jsonl").collect()
    with pytest.raises(ValueError):
        facts.read_facts(spark, "x.xml")


def test_round_trips(spark, tmp_path):
    base = Base(spark).insert("p", [("a", "b"), ("c", "d")]).insert("q", [("x",)]).insert("q", [("y",)], negated=True)
    facts.write_parquet(base.facts(), f"{tmp_path}/kb")
    again = Base(spark).load(facts.read_facts(spark, f"{tmp_path}/kb", "parquet"))
    key = lambda df: sorted((r.predicate, tuple(r.args), r.negated) for r in df.collect())
    assert key(again.facts()) == key(base.facts())
    lines = [json.loads(r.value) for r in facts.export_jsonl(base.facts()).collect()]
    assert {"predicate": "p", "args": ["a", "b"]} in lines
    whole = {r.predicate: json.loads(r.facts) for r in facts.export_json(base.facts().where("not negated")).collect()}
    assert whole == {"p": [["a", "b"], ["c", "d"]], "q": [["x"]]}
    facts.export_jsonl(base.facts()).write.text(f"{tmp_path}/kb.jsonl")
    assert key(facts.read_facts(spark, f"{tmp_path}/kb.jsonl")) == key(base.facts())
    many = Base(spark).register("n", spark.range(25_000).selectExpr("string(id) AS a")).facts()
    parts = facts.export_json(many).collect()
    assert len(parts) == 3 and sorted(x for r in parts for x in json.loads(r.facts)) == sorted([str(i)] for i in range(25_000))


def test_scores():
    assert abs(score(2, 1) - 0.92388) < 1e-5 and abs(score(3, 2) - 0.6947) < 1e-4 and score(1, 0) == 1
    assert abs(joint_score(2, 0, 2) - 0.8155) < 1e-4 and joint_score(3, 3, 0) == 1


def test_beliefs(spark):
    items = [("l", 0.7, False), ("l", 0.4, True), ("m", 0.8, False), ("m", 0.9, False), ("n", 0.2, True), ("o", 0.0, False)]
    frame = spark.createDataFrame(items, "literal string, weight double, negated boolean")
    got = {r.literal: (round(r.supp_pos, 3), round(r.supp_neg, 3), r.state) for r in beliefs.beliefs(beliefs.checked(frame), ["literal"]).collect()}
    assert got == {"l": (0.7, 0.4, "contradictory"), "m": (1.0, 0.0, "consistent"), "n": (0.0, 0.2, "denied"), "o": (0.0, 0.0, "unknown")}
    bad = spark.createDataFrame([("l", 1.2, False, "FACT")], "literal string, weight double, negated boolean, kind string")
    with pytest.raises(Exception, match="weight in 0 to 1"):
        beliefs.checked(bad).collect()


def test_traces(spark):
    trace = traces.Trace()
    a = trace.record("query", {"k": 1})
    b = trace.record("chaining", {}, (a,))
    c = trace.record("retrieval", {}, (b,))
    trace.record("query", {})
    told = traces.Trace()
    base = Base(spark, trace=told).insert("e", [("a", "b"), ("b", "c")])
    base.derive([rule(atom("t", X, Y), atom("e", X, Y)), rule(atom("t", X, Z), atom("t", X, Y), atom("e", Y, Z))]).base.query(atom("t", "a", X))
    assert [e[2] for e in told.events] == ["derive", "round", "round", "round", "query"]
    assert {r.id for r in traces.ancestors(told.frame(spark), told.events[3][0]).collect()} == {e[0] for e in told.events[:4]}
    assert {r.id for r in traces.ancestors(trace.frame(spark), c).collect()} == {a, b, c}


def test_vectors_undo_and_read_off(spark):
    v = spark.createDataFrame([([1.0, 2.0, -3.0, 0.5],)], "v array<double>")
    col = F.col("v")
    got = v.select(V.permute(V.permute(col, 3), -3).alias("same"), V.similarity(col, col).alias("one"), V.norm(V.normalize(col)).alias("n"),
                   V.unbind(V.bind(col, V.permute(col, 1)), V.permute(col, 1)).alias("back")).first()
    assert got.same == got.back == [1.0, 2.0, -3.0, 0.5] and abs(got.one - 1) < 1e-12 and abs(got.n - 1) < 1e-9
    rows = spark.createDataFrame([("1", "likes", ["ann", "bob"]), ("2", "likes", ["bob", "cy"])], "id string, predicate string, args array<string>")
    coded = vectors.encode(rows, 512)
    names = vectors.codebook(spark.createDataFrame([("ann",), ("bob",), ("cy",)], "n string"), "E", 512)
    for place, want in ((1, {"1": "ann", "2": "bob"}), (2, {"1": "bob", "2": "cy"})):
        noisy = vectors.argument(coded, place, 512).selectExpr("id AS query", "arg AS vec")
        found = vectors.cleanup(noisy, names).collect()
        assert {r.query: r.name for r in found} == want
        assert all(abs(r.similarity - score(2, 0)) < 0.15 for r in found)
    one = coded.where("id = '1'").first().vec
    assert not vectors.is_novel(coded.select("id", "vec"), one, 0.9) and vectors.is_novel(coded.where("id = '2'").select("id", "vec"), one, 0.9)


def test_contradicted_rows_with_nulls_leave(spark):
    both = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    base = Base(spark).register("p", both).register("p", both.where("y is null"), negated=True)
    fixed = consistency.enforce(base, "remove_both")
    assert [tuple(r) for r in fixed.relation(("p", 2, False)).collect()] == [("b", "c")]
    assert consistency.check(fixed).consistent


def test_equal_vectors_rank_without_the_query(spark):
    rows = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)] + [(9, None), (10, [0.0, 0.0])], "name long, vec array<double>")
    asked = rows.selectExpr("name AS query", "vec")
    got = vectors.cleanup(asked, rows, 2, others=True).collect()
    want = {i: [x for x in range(5) if x != i][:2] for i in range(5)}
    assert {i: [r.name for r in sorted(got, key=lambda r: r.rank) if r.query == i] for i in want} == want and len(got) == 10
    assert {r.rank for r in got} == {1, 2}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        tables.shared_folder(Session())


def test_scratch_tables_go_once_the_result_is_written(spark, tmp_path):
    import os

    x, y, z = Var("X"), Var("Y"), Var("Z")
    rules = [rule(atom("t", x, y), atom("e", x, y)), rule(atom("t", x, z), atom("t", x, y), atom("e", y, z))]
    kept = tables.settle(spark.range(3), "kept")
    folder = tables.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with tables.scratch(spark):
        base = Base(spark).insert("e", [("a", "b"), ("b", "c")])
        base.derive(rules).base.relation(("t", 2, False)).write.parquet(f"{tmp_path}/t")
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and kept.count() == 3
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
