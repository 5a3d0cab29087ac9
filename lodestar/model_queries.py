"""Registered queries over models: undefined rows, demand through absence, proofs, values, totals, bands, answer tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import phases
from lodestar.operators import atoms, nearest
from lodestar.plans import annotated, proofs, tabling
from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Var, absent, atom, compare, rule, total, within
from lodestar.queries import LINEAR, TREE, _flat, _sql_flat, _vectors, longs, query, read, star

A, B, N, P, Q, R, S, X, Y, Z = (Var(v) for v in "ABNPQRSXYZ")

#: Levels of the game that the SQL goes through; the tables' games end far below.
LEVELS = 30
_MOVES = """mv AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey > 0 AND c_custkey % 5 <> 2
  UNION SELECT c_custkey, (7 * c_custkey + 3) % 1000 FROM customer WHERE c_custkey % 4 = 0),
nd AS (SELECT a AS n FROM mv UNION SELECT b FROM mv), w0 AS (SELECT a AS n FROM mv WHERE false)"""
_GAME = ",\n".join(
    f"""l{k} AS MATERIALIZED (SELECT n FROM nd WHERE n NOT IN (SELECT a FROM mv WHERE b NOT IN (SELECT n FROM w{k - 1}))),
w{k} AS MATERIALIZED (SELECT DISTINCT a AS n FROM mv WHERE b IN (SELECT n FROM l{k}))"""
    for k in range(1, LEVELS + 1)
)


@query(f"""
WITH {_MOVES}, {_GAME}
SELECT n, 'won' AS state FROM w{LEVELS}
UNION ALL SELECT n, 'open' FROM nd WHERE n NOT IN (SELECT n FROM w{LEVELS}) AND n NOT IN (SELECT n FROM l{LEVELS})""")
def wf_game(spark, sf_dir):
    """Who wins a game of moves with cycles, and whose game never ends: ``win(X) :- move(X, Y), not win(Y)``."""
    rows = read(spark, sf_dir, "customer")
    tree = rows.where("c_custkey > 0 and c_custkey % 5 != 2").selectExpr("c_custkey AS a", "c_custkey div 3 AS b")
    move = tree.union(rows.where("c_custkey % 4 = 0").selectExpr("c_custkey", "(7 * c_custkey + 3) % 1000")).distinct()
    run = Base(spark).register("move", move).derive([rule(atom("win", X), atom("move", X, Y), absent("win", Y))])
    key = ("win", 1, False)
    won = longs(run.base.relation(key), n="a1").withColumn("state", F.lit("won"))
    return won.union(longs(run.undefined[key], n="a1").withColumn("state", F.lit("open"))) if key in run.undefined else won


@query(f"""
{TREE} SELECT y.s_suppkey AS y FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey = 7
AND NOT EXISTS (SELECT 1 FROM t WHERE t.a = 7 AND t.b = y.s_suppkey) AND NOT EXISTS (SELECT 1 FROM t WHERE t.b = 7 AND t.a = y.s_suppkey)""")
def bc_absent(spark, sf_dir):
    """Who of a supplier's nation stands neither above nor below it; only its own links are derived."""
    apart = rule(atom("apart", X, Y), atom("supp_in", X, N), atom("supp_in", Y, N), absent("anc", X, Y), absent("anc", Y, X))
    return longs(star(spark, sf_dir).answers(atom("apart", 7, Y), [*LINEAR, apart]), y="Y")


@query(f"""
{TREE} SELECT 'above 40' AS goal, a AS x FROM t WHERE b = 40 UNION ALL SELECT '1 above 40', a FROM t WHERE a = 1 AND b = 40
UNION ALL SELECT 'hits', 1 UNION ALL SELECT 'misses', 1""")
def bc_tabled(spark, sf_dir):
    """Two goals, the second answered by the first one's table."""
    tables = tabling.Tabled(star(spark, sf_dir), LINEAR)
    wide = longs(tables.answers(atom("anc", X, 40)), x="X").select(F.lit("above 40").alias("goal"), "x")
    narrow = tables.answers(atom("anc", 1, 40)).select(F.lit("1 above 40"), F.lit(1).cast("long"))
    counted = spark.createDataFrame([(k, v) for k, v in tables.stats().items() if k != "tables"], "goal string, x long")
    return wide.union(narrow).union(counted)


# -- proofs ----------------------------------------------------------------------------------


def _args(text: str) -> list:
    """The two numbers that a fact's text ends with."""
    args = F.from_json(F.regexp_extract(text, r"(\[.*)$", 1), "array<string>")
    return [args[i].cast("long").alias(name) for i, name in enumerate("xz")]


@query("""
WITH RECURSIVE m AS (SELECT s_suppkey // 3 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0),
t AS (SELECT a, b, 1 AS d FROM m UNION ALL SELECT m.a, t.b, d + 1 FROM m JOIN t ON m.b = t.a)
SELECT a AS x, b AS z, CAST(min(d) AS BIGINT) AS height, CAST(min(d) AS BIGINT) AS leaves FROM t GROUP BY a, b""")
def proof_least(spark, sf_dir):
    """A least proof of everyone above everyone: its height, and how many given facts it ends in."""
    found = proofs.proofs(star(spark, sf_dir), LINEAR, atom("anc", X, Z)).trees(atom("anc", X, Z))
    # The goal's own row of a tree, whose text alone is parsed, and the tree's leaves in one pass.
    top = F.col("fact") == F.col("root")
    own = {"x": _args("text")[0], "z": _args("text")[1], "height": F.col("height").cast("long")}
    leaves = F.sum((F.col("height") == 0).cast("long")).alias("leaves")
    return found.groupBy("root").agg(*(F.max(F.when(top, value)).alias(name) for name, value in own.items()), leaves).drop("root")


_TWO = """m AS (SELECT s_suppkey // 3 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0
  UNION SELECT s_suppkey // 2, s_suppkey FROM supplier WHERE s_suppkey > 0)"""


def _two_links(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").where("s_suppkey > 0")
    return rows.selectExpr("s_suppkey div 3 AS a", "s_suppkey AS b").union(rows.selectExpr("s_suppkey div 2", "s_suppkey")).distinct()


@query(f"""
WITH RECURSIVE {_TWO}, p AS (SELECT a, b, 1 AS d FROM m UNION ALL SELECT m.a, p.b, d + 1 FROM m JOIN p ON m.b = p.a)
SELECT a AS x, b AS z, CAST(d AS BIGINT) AS height, count(*) AS proofs FROM p GROUP BY a, b, d""")
def proof_counts(spark, sf_dir):
    """How many proofs of every height there are where ways meet again: the bag of a goal's proofs."""
    base = Base(spark).register("manages", _two_links(spark, sf_dir))
    counted = proofs.counted(base, LINEAR, atom("anc", X, Z))
    return counted.select(*(F.col(c).cast("long").alias(name) for c, name in (("a1", "x"), ("a2", "z"), ("height", "height"), ("proofs", "proofs"))))


# -- values ----------------------------------------------------------------------------------


def _ways(weight: str, best: str, times: str) -> str:
    return f"""
WITH RECURSIVE {_TWO}, v AS (SELECT a, b, {weight} AS w FROM m),
p AS (SELECT a, b, w FROM v UNION ALL SELECT v.a, p.b, {times} FROM v JOIN p ON v.b = p.a)
SELECT a AS x, b AS z, round(CAST({best}(w) AS DOUBLE), 6) AS value FROM p GROUP BY a, b"""


def _valued(spark, sf_dir, weight: str, algebra: annotated.Algebra) -> DataFrame:
    rows = _two_links(spark, sf_dir).selectExpr("a", "b", weight)
    run = annotated.best_values(Base(spark), LINEAR, {"manages": rows}, algebra)
    return longs(run.query(atom("anc", X, Z)), x="X", z="Z", value="value")


@query(_ways("CAST(0.95 AS DOUBLE) - (b - a) % 7 / CAST(20 AS DOUBLE)", "max", "v.w * p.w"))
def score_best_path(spark, sf_dir):
    """The surest way from everyone to everyone below, links being sure to a degree."""
    return _valued(spark, sf_dir, "0.95D - (b - a) % 7 / 20D", annotated.PRODUCT)


@query(_ways("(b - a) % 9 + 1", "min", "v.w + p.w"))
def path_shortest(spark, sf_dir):
    """The shortest way: a minimum inside recursion."""
    return _valued(spark, sf_dir, "double((b - a) % 9 + 1)", annotated.SHORTEST)


@query("""
WITH RECURSIVE v AS (SELECT n_nationkey AS a, (7 * n_nationkey + 3) % 25 AS b, 1 - n_nationkey / CAST(50 AS DOUBLE) AS w FROM nation
  UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, CAST(0.5 AS DOUBLE) + n_regionkey / CAST(20 AS DOUBLE) FROM nation),
e AS (SELECT a, b, max(w) AS w FROM v GROUP BY a, b),
p AS (SELECT a, b, w FROM e UNION SELECT p.a, e.b, least(p.w, e.w) FROM p JOIN e ON p.b = e.a)
SELECT CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS z, round(max(w), 6) AS value FROM p GROUP BY a, b""")
def score_weakest(spark, sf_dir):
    """The way whose weakest link is strongest, over links with cycles."""
    rows = read(spark, sf_dir, "nation")
    links = rows.selectExpr("n_nationkey AS a", "(7 * n_nationkey + 3) % 25 AS b", "1 - n_nationkey / 50D AS w").union(
        rows.selectExpr("n_nationkey", "(n_nationkey + 1) % 25", "0.5D + n_regionkey / 20D")
    )
    rules = [rule(atom("way", X, Y), atom("link", X, Y)), rule(atom("way", X, Z), atom("way", X, Y), atom("link", Y, Z))]
    run = annotated.best_values(Base(spark), rules, {"link": links}, annotated.WEAKEST)
    return longs(run.query(atom("way", X, Z)), x="X", z="Z", value="value")


# -- totals and bands ------------------------------------------------------------------------


@query("""
WITH n AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey),
m AS (SELECT s_nationkey AS n, max(parts) AS most FROM n JOIN supplier ON s_suppkey = s GROUP BY s_nationkey)
SELECT s, CAST(m.n AS BIGINT) AS nation, parts FROM n JOIN supplier ON s_suppkey = s JOIN m ON m.n = s_nationkey WHERE parts = most""")
def agg_heads(spark, sf_dir):
    """Suppliers of most parts in their nation: a count below a maximum below a rule."""
    rules = [
        rule(atom("parts", S, total("count", P)), atom("sale", ANY, P, S)),
        rule(atom("most", N, total("max", B)), atom("supp_in", S, N), atom("parts", S, B)),
        rule(atom("first", S, N, B), atom("parts", S, B), atom("supp_in", S, N), atom("most", N, B)),
    ]
    return longs(star(spark, sf_dir).derive(rules).base.query(atom("first", S, N, B)), s="S", nation="N", parts="B")


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE
WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND a.value < b.value""")
def band_events(spark, sf_dir):
    """Purchases within ten minutes after an error, of any user, and of more value: no equal key, only comparisons."""
    rows = read(spark, sf_dir, "events")
    base = Base(spark).register("failed", rows.where("event_type = 'error'"), ["event_id", "ts", "value"])
    base.register("bought", rows.where("event_type = 'purchase'"), ["event_id", "ts", "value"])
    soon = rule(
        atom("soon", A, B), atom("failed", A, X, P), atom("bought", B, Y, Q),
        within(X, Y, timedelta(0), timedelta(minutes=10)), compare(P, "<", Q),
    )
    return longs(base.follows(soon), a="a1", b="a2")


@query("""
SELECT a.s_suppkey AS s, count(*) AS below FROM supplier a JOIN supplier b ON b.s_acctbal < a.s_acctbal GROUP BY a.s_suppkey""")
def band_open(spark, sf_dir):
    """How many suppliers have less on their account: a comparison without a bound below, counted by a head."""
    base = Base(spark).register("has", read(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"])
    less = rule(atom("less", A, total("count", B)), atom("has", A, X), atom("has", B, Y), compare(Y, "<", X))
    return longs(base.derive([less]).base.query(atom("less", S, N)), s="S", below="N")


# -- phases, blind decoding, indexed cleanup ---------------------------------------------------

_WRAP = "({0}) - 2 * pi() * floor((({0}) + pi()) / (2 * pi()))"
_NEXT = "v[(i - 2 + 64) % 64 + 1]"


def _shifted(vec):
    from lodestar.functions import vectors as V

    return V.permute(vec, 1)


@query(_sql_flat(_WRAP.format(f"4 * v[i] + 4 * {_NEXT}")))
def phase_bind(spark, sf_dir):
    """Embeddings as angles, each bound to itself shifted by one."""
    angles = phases.power(F.col("vec"), 4)
    return _flat(_vectors(spark, sf_dir).withColumn("vec", phases.bind(angles, phases.power(_shifted(F.col("vec")), 4))))


@query(_sql_flat(_WRAP.format(f"v[i] - {_NEXT}")))
def phase_unbind(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir).withColumn("vec", phases.unbind(F.col("vec"), _shifted(F.col("vec")))))


@query(_sql_flat(_WRAP.format("v[i] * 50")))
def phase_power(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir).withColumn("vec", phases.power(F.col("vec"), 50)))


@query("""
WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS pos, round(sum(cos(4 * v[i])), 6) AS re, round(sum(sin(4 * v[i])), 6) + CAST(0 AS DOUBLE) AS im
FROM (SELECT *, unnest(range(1, 65)) AS i FROM e) GROUP BY label, i""")
def phase_bundle(spark, sf_dir):
    """The complex sum of each label's embeddings as angles."""
    rows = _vectors(spark, sf_dir).select("label", F.posexplode(phases.power(F.col("vec"), 4)).alias("pos", "t"))
    sums = rows.groupBy("label", "pos").agg(F.sum(F.cos("t")).alias("re"), F.sum(F.sin("t")).alias("im"))
    return sums.select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), F.round("re", 6).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


_COMPLEX = "list_sum(list_transform(range(1, 65), lambda i: {0}(4 * a.v[i] - 4 * b.v[i])))"


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT b.vec_id, round(sqrt({_COMPLEX.format('cos')} ** 2 + {_COMPLEX.format('sin')} ** 2) / 64, 6) AS similarity FROM e a, e b WHERE a.vec_id = 0""")
def phase_similarity(spark, sf_dir):
    """How similar every embedding is to the first, both as angles."""
    rows = _vectors(spark, sf_dir).select("vec_id", phases.complex_of(phases.power(F.col("vec"), 4)).alias("v"))
    first = rows.where("vec_id = 0").select(F.col("v").alias("first"))
    found = rows.join(F.broadcast(first.limit(1)))  # one row
    return longs(found.withColumn("similarity", phases.similarity(F.col("v"), F.col("first"))), vec_id="vec_id", similarity="similarity")


_ATOMS = """SELECT s_suppkey AS id, 'supp' || s_nationkey % 3 AS predicate, list_slice(['s' || s_suppkey, 'n' || s_nationkey,
  CASE WHEN s_acctbal < 0 THEN 'owes' ELSE 'has' END, 'k' || s_suppkey % 7, 'z' || s_suppkey % 4], 1, 1 + s_suppkey % 5) AS args FROM supplier"""


@query(f"SELECT CAST(id AS BIGINT) AS id, predicate, array_to_string(args, ' ') AS args FROM ({_ATOMS})")
def vec_decode_atoms(spark, sf_dir):
    """Facts of one to five arguments as single vectors, and read off them again, nothing being known of any."""
    size = 1024
    facts = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "concat('supp', s_nationkey % 3) AS predicate",
        "slice(array(concat('s', s_suppkey), concat('n', s_nationkey), if(s_acctbal < 0, 'owes', 'has'), concat('k', s_suppkey % 7),"
        " concat('z', s_suppkey % 4)), 1, int(1 + s_suppkey % 5)) AS args",
    )
    predicates = atoms.symbols(facts.select("predicate"), "P", size)
    entities = atoms.symbols(facts.select(F.explode("args").alias("name")), "E", size)
    found = atoms.decode(atoms.encode(facts, size).select("id", "vec"), predicates, entities)
    return found.select(F.col("id").cast("long").alias("id"), "predicate", F.array_join("args", " ").alias("args"))


@query(None)
def vec_indexed(spark, sf_dir):
    """The five nearest of every twentieth embedding through hyperplane buckets; tests measure the recall."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "vec")
    found = nearest.indexed_cleanup(asked, rows.select(F.col("vec_id").alias("name"), "vec"), 5, others=True)
    return longs(found, query="query", rank="rank", name="name", similarity="similarity")
