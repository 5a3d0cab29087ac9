"""The registered queries of the deductive operators over the star schema, with their SQL.

``CATALOGUE`` maps a name to (function of spark and sf_dir, DuckDB SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.functions.scores import joint_score, probe_score
from lodestar.operators import beliefs, consistency, traces, vectors
from lodestar.plans.base import Base
from lodestar.plans.rules import ANY, Var, absent, atom, bindings, denied, rule
from lodestar.sources import facts, tables
from lodestar.streaming.ingest import LiveBase

A, B, C, D, N, O, P, Q, R, S, X, Y, Z = (Var(v) for v in "ABCDNOPQRSXYZ")
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: predicate: table, columns, condition; columns may be expressions, and ``~`` marks negative facts.
STAR = {
    "nation_in": ("nation", "n_nationkey, n_regionkey", None),
    "region": ("region", "r_regionkey", None),
    "supp_in": ("supplier", "s_suppkey, s_nationkey", None),
    "cust_in": ("customer", "c_custkey, c_nationkey", None),
    "cust": ("customer", "c_custkey", None),
    "placed": ("orders", "o_custkey, o_orderkey", None),
    "ord": ("orders", "o_orderkey", None),
    "urgent": ("orders", "o_custkey", "o_orderpriority = '1-URGENT'"),
    "has_part": ("lineitem", "l_orderkey, l_partkey", None),
    "returned": ("lineitem", "l_orderkey", "l_returnflag = 'R'"),
    "sale": ("lineitem", "l_orderkey, l_partkey, l_suppkey", None),
    "brand": ("part", "p_partkey, p_brand", None),
    "etype": ("events", "event_type", None),
    "did": ("events", "user_id, event_type", None),
    "manages": ("supplier", "s_suppkey div 3, s_suppkey", "s_suppkey > 0"),
    "above": ("customer", "c_custkey div 3, c_custkey", "c_custkey > 0"),
    "adj": ("nation", "n_nationkey, (7 * n_nationkey + 3) % 25", None),
    "doc": ("documents", "doc_id", None),
    "labelled": ("labels", "doc_id, quality", None),
    "good": ("labels", "doc_id", "quality = 1"),
    "bad": ("labels", "doc_id", "toxic = 1"),
    "~good": ("labels", "doc_id", "toxic = 1"),
}


def star(spark: SparkSession, sf_dir: str) -> Base:
    """The tables as predicates; a table is opened only if a query names a predicate of it."""
    base = Base(spark)
    for name, (table, columns, condition) in STAR.items():
        parts = columns.split(", ")

        def rows(table: str = table, parts: list[str] = parts, condition: str | None = condition) -> DataFrame:
            df = read(spark, sf_dir, table)
            df = df.where(condition) if condition else df
            found = df.selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(parts)))
            return found.distinct() if table == "events" and len(parts) == 1 else found

        base.declare(name.lstrip("~"), [f"c{i}" for i in range(len(parts))], rows, negated=name[0] == "~")
    return base


def longs(df: DataFrame, **names: str) -> DataFrame:
    """Columns renamed; whole numbers as long, doubles rounded."""
    kinds = dict(df.dtypes)

    def value(c: str):
        if kinds[c] in ("int", "bigint"):
            return F.col(c).cast("long")
        return F.round(c, 6) if kinds[c] == "double" else F.col(c)

    return df.select(*(value(old).alias(new) for new, old in names.items()))


def value(arity: int, bound: int, free: int) -> str:
    return f"CAST({round(joint_score(arity, bound, free), 6)} AS DOUBLE)"


# -- goals ---------------------------------------------------------------------------------


@query("""
SELECT 'nation_in(1, 1)' AS goal, CAST(1 AS DOUBLE) AS score WHERE EXISTS (
  SELECT 1 FROM nation WHERE n_nationkey = 1 AND n_regionkey = 1)
UNION ALL SELECT 'nation_in(1, 2)', 1 WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 1 AND n_regionkey = 2)
""")
def q_ground(spark, sf_dir):
    base = star(spark, sf_dir)
    parts = [base.ask(atom("nation_in", 1, r)).select(F.lit(f"nation_in(1, {r})").alias("goal"), "score") for r in (1, 2)]
    return parts[0].union(parts[1])


@query(f"SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS n, {value(2, 1, 1)} AS score FROM nation WHERE n_regionkey = 1")
def q_one_var(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("nation_in", N, 1)), n="N", score="score")


@query(f"SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS n, {value(2, 1, 1)} AS score FROM supplier WHERE s_suppkey = 5")
def q_one_var_rev(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("supp_in", 5, N)), n="N", score="score")


@query("SELECT DISTINCT doc_id AS d, CAST(1 AS DOUBLE) AS score FROM labels WHERE quality = 1 ORDER BY d LIMIT 25")
def q_unary_top(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("good", D), k=25), d="D", score="score")


@query(f"SELECT DISTINCT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n, {value(2, 0, 2)} AS score FROM customer")
def q_two_var(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("cust_in", C, N)), c="C", n="N", score="score")


@query(f"SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, {value(3, 1, 2)} AS score FROM lineitem WHERE l_partkey = 7")
def q_three_partial(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("sale", O, 7, S)), o="O", s="S", score="score")


@query(f"""
SELECT * FROM (SELECT DISTINCT CAST(1 AS BIGINT) AS position, l_orderkey AS value, {value(3, 1, 1)} AS score
  FROM lineitem WHERE l_partkey = 7 ORDER BY value LIMIT 5)
UNION ALL SELECT * FROM (SELECT DISTINCT CAST(3 AS BIGINT), l_suppkey, {value(3, 1, 1)}
  FROM lineitem WHERE l_partkey = 7 ORDER BY 2 LIMIT 5)
""")
def q_all_vars(spark, sf_dir):
    found = star(spark, sf_dir).query_positions(atom("sale", O, 7, S), 5)
    return longs(found.withColumn("value", F.col("value").cast("long")), position="position", value="value", score="score")


@query("SELECT CAST(n_nationkey AS BIGINT) AS x FROM nation WHERE n_nationkey = (7 * n_nationkey + 3) % 25")
def q_repeat_var(spark, sf_dir):
    return longs(star(spark, sf_dir).query(atom("adj", X, X)), x="X")


@query(f"SELECT DISTINCT doc_id AS d, CAST(1 AS DOUBLE) AS score FROM labels WHERE toxic = 1")
def q_negative(spark, sf_dir):
    return longs(star(spark, sf_dir).query(denied("good", D)), d="D", score="score")


@query("""
SELECT user_id AS u, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def q_count_of_answers(spark, sf_dir):
    return star(spark, sf_dir).query(atom("did", X, Y)).groupBy(F.col("X").alias("u")).agg(F.count("*").alias("n"))


# -- rules ---------------------------------------------------------------------------------


def head(spark, sf_dir, rules, goal, **names):
    """The goal's variables after the rules ran."""
    return longs(star(spark, sf_dir).derive(rules).base.query(goal), **names)


@query("""
SELECT DISTINCT s_suppkey AS s, CAST(n_regionkey AS BIGINT) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def r_two_hop(spark, sf_dir):
    rules = [rule(atom("supp_region", S, R), atom("supp_in", S, N), atom("nation_in", N, R))]
    return head(spark, sf_dir, rules, atom("supp_region", S, R), s="S", r="R")


MANAGES = "m AS (SELECT s_suppkey // 3 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0)"


@query(f"WITH {MANAGES} SELECT DISTINCT x.a AS x, y.b AS z FROM m x JOIN m y ON x.b = y.a")
def r_self_join(spark, sf_dir):
    rules = [rule(atom("gp", X, Z), atom("manages", X, Y), atom("manages", Y, Z))]
    return head(spark, sf_dir, rules, atom("gp", X, Z), x="X", z="Z")


@query("""
SELECT DISTINCT a.p_partkey AS q FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE b.p_partkey = 7""")
def r_common(spark, sf_dir):
    rules = [rule(atom("same_brand", Q), atom("brand", 7, B), atom("brand", Q, B))]
    return head(spark, sf_dir, rules, atom("same_brand", Q), q="Q")


@query("""
SELECT CAST(r_regionkey AS BIGINT) AS r, event_type AS t FROM region, (SELECT DISTINCT event_type FROM events)""")
def r_cross(spark, sf_dir):
    rules = [rule(atom("pair", R, X), atom("region", R), atom("etype", X))]
    return head(spark, sf_dir, rules, atom("pair", R, X), r="R", t="X")


@query("SELECT DISTINCT a.doc_id AS d FROM labels a JOIN labels b USING (doc_id) WHERE a.quality = 1 AND b.toxic = 1")
def r_bound_atom(spark, sf_dir):
    rules = [rule(atom("both", D), atom("good", D), atom("bad", D))]
    return head(spark, sf_dir, rules, atom("both", D), d="D")


@query("""
SELECT DISTINCT o_custkey AS c FROM orders WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 1 AND n_regionkey = 1)""")
def r_ground_atom(spark, sf_dir):
    rules = [rule(atom("active", C), atom("nation_in", 1, 1), atom("placed", C, O))]
    return head(spark, sf_dir, rules, atom("active", C), c="C")


@query("SELECT DISTINCT c_custkey AS c, 'near' AS tier FROM customer WHERE c_nationkey = 3")
def r_const_head(spark, sf_dir):
    rules = [rule(atom("tier", C, "near"), atom("cust_in", C, 3))]
    return head(spark, sf_dir, rules, atom("tier", C, X), c="C", tier="X")


@query("""
SELECT s_suppkey AS x FROM supplier WHERE s_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3""")
def r_union(spark, sf_dir):
    rules = [rule(atom("local", X), atom("supp_in", X, 3)), rule(atom("local", X), atom("cust_in", X, 3))]
    return head(spark, sf_dir, rules, atom("local", X), x="X")


@query(f"""
SELECT s_suppkey AS s, CAST(n_regionkey AS BIGINT) AS r, CAST({round(probe_score(2, 1, 1), 6)} AS DOUBLE) AS score
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def r_score(spark, sf_dir):
    base = star(spark, sf_dir)
    body = (atom("supp_in", S, N), atom("nation_in", N, R))
    return longs(bindings(body, lambda a, _: base.relation(a.key), scored=True), s="S", r="R", score="score")


@query("""
WITH f AS (SELECT s_suppkey, s_nationkey FROM supplier ORDER BY 2, 1 LIMIT 50),
j AS (SELECT s_suppkey AS s, n_regionkey AS r FROM f JOIN nation ON s_nationkey = n_nationkey ORDER BY s_nationkey, n_regionkey, s_suppkey LIMIT 50)
SELECT DISTINCT s, CAST(r AS BIGINT) AS r FROM j""")
def r_beam(spark, sf_dir):
    base = star(spark, sf_dir)
    body = (atom("supp_in", S, N), atom("nation_in", N, R))
    ordered = (atom("by_nation", N, S), body[1])
    base.register("by_nation", read(spark, sf_dir, "supplier"), ["s_nationkey", "s_suppkey"])
    return longs(bindings(ordered, lambda a, _: base.relation(a.key), beam=50).select("S", "R").distinct(), s="S", r="R")


@query("""
SELECT DISTINCT s_suppkey AS s, l_orderkey AS o, l_partkey AS p FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey = 3""")
def r_new_variables(spark, sf_dir):
    rules = [rule(atom("sold", S, O, P), atom("supp_in", S, 3), atom("sale", O, P, S))]
    return head(spark, sf_dir, rules, atom("sold", S, O, P), s="S", o="O", p="P")


@query("""
WITH RECURSIVE e AS (SELECT CAST(NULLIF(n_nationkey % 7, 0) AS BIGINT) AS a, CAST(NULLIF(n_regionkey, 2) AS BIGINT) AS b FROM nation)
SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e""")
def rec_nulls(spark, sf_dir):
    """A symmetric relation over rows with nulls ends: a null is known where it was before."""
    rows = read(spark, sf_dir, "nation").selectExpr("nullif(n_nationkey % 7, 0) AS a", "nullif(n_regionkey, 2) AS b")
    run = Base(spark).register("e", rows).derive([rule(atom("e", Y, X), atom("e", X, Y))])
    return longs(run.base.query(atom("e", X, Y)), x="X", y="Y")


@query(f"""
WITH {MANAGES} SELECT a AS x, b AS y FROM m WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = m.b AND s_nationkey = 3)
AND NOT EXISTS (SELECT 1 FROM m n WHERE n.a = m.b)""")
def r_novel_rows(spark, sf_dir):
    rules = [rule(atom("leaf", X, Y), atom("manages", X, Y), absent("supp_in", Y, 3), absent("manages", Y, ANY))]
    return head(spark, sf_dir, rules, atom("leaf", X, Y), x="X", y="Y")


# -- recursion -----------------------------------------------------------------------------

LINEAR = [rule(atom("anc", X, Y), atom("manages", X, Y)), rule(atom("anc", X, Z), atom("manages", X, Y), atom("anc", Y, Z))]
TREE = f"WITH RECURSIVE {MANAGES}, t AS (SELECT a, b FROM m UNION SELECT m.a, t.b FROM m JOIN t ON m.b = t.a)"


@query(f"{TREE} SELECT a AS x, b AS z FROM t")
def rec_linear(spark, sf_dir):
    return head(spark, sf_dir, LINEAR, atom("anc", X, Z), x="X", z="Z")


@query("""
WITH RECURSIVE m AS (SELECT c_custkey // 3 AS a, c_custkey AS b FROM customer WHERE c_custkey > 0),
t AS (SELECT a, b FROM m UNION SELECT m.a, t.b FROM m JOIN t ON m.b = t.a) SELECT a AS x, b AS z FROM t""")
def rec_customers(spark, sf_dir):
    rules = [rule(atom("anc", X, Y), atom("above", X, Y)), rule(atom("anc", X, Z), atom("above", X, Y), atom("anc", Y, Z))]
    return head(spark, sf_dir, rules, atom("anc", X, Z), x="X", z="Z")


PAIRWISE = [rule(atom("con", X, Y), atom("manages", X, Y)), rule(atom("con", X, Z), atom("con", X, Y), atom("con", Y, Z))]


@query(f"{TREE} SELECT a AS x, b AS z FROM t")
def rec_nonlinear(spark, sf_dir):
    return head(spark, sf_dir, PAIRWISE, atom("con", X, Z), x="X", z="Z")


@query(f"{TREE} SELECT a AS x, b AS z FROM t")
def rec_naive(spark, sf_dir):
    return longs(star(spark, sf_dir).derive(PAIRWISE, naive=True).base.query(atom("con", X, Z)), x="X", z="Z")


ADJ = "m AS (SELECT n_nationkey AS a, (7 * n_nationkey + 3) % 25 AS b FROM nation)"


@query(f"""
WITH RECURSIVE {ADJ}, t AS (SELECT a, b FROM m UNION SELECT t.a, m.b FROM t JOIN m ON t.b = m.a)
SELECT CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS z FROM t""")
def rec_cyclic(spark, sf_dir):
    rules = [rule(atom("reach", X, Y), atom("adj", X, Y)), rule(atom("reach", X, Z), atom("reach", X, Y), atom("adj", Y, Z))]
    return head(spark, sf_dir, rules, atom("reach", X, Z), x="X", z="Z")


@query(f"""
WITH RECURSIVE {ADJ}, s AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
t AS (SELECT a, b FROM s UNION SELECT t.a, s.b FROM t JOIN s ON t.b = s.a)
SELECT CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS z FROM t""")
def rec_symmetric(spark, sf_dir):
    rules = [
        rule(atom("adj", Y, X), atom("adj", X, Y)),
        rule(atom("reach", X, Y), atom("adj", X, Y)),
        rule(atom("reach", X, Z), atom("reach", X, Y), atom("adj", Y, Z)),
    ]
    return head(spark, sf_dir, rules, atom("reach", X, Z), x="X", z="Z")


@query(f"""
WITH RECURSIVE {MANAGES}, t AS (SELECT a, b, 1 AS odd FROM m UNION SELECT t.a, m.b, 1 - t.odd FROM t JOIN m ON t.b = m.a)
SELECT a AS x, b AS z, CASE WHEN odd = 1 THEN 'odd' ELSE 'even' END AS parity FROM t""")
def rec_mutual(spark, sf_dir):
    rules = [
        rule(atom("odd", X, Y), atom("manages", X, Y)),
        rule(atom("even", X, Z), atom("odd", X, Y), atom("manages", Y, Z)),
        rule(atom("odd", X, Z), atom("even", X, Y), atom("manages", Y, Z)),
    ]
    base = star(spark, sf_dir).derive(rules).base
    parts = [longs(base.query(atom(p, X, Z)), x="X", z="Z").withColumn("parity", F.lit(p)) for p in ("odd", "even")]
    return parts[0].union(parts[1])


@query(f"""
WITH RECURSIVE {MANAGES}, t AS (SELECT a, b, 1 AS d FROM m UNION SELECT m.a, t.b, d + 1 FROM m JOIN t ON m.b = t.a WHERE d < 3)
SELECT a AS x, b AS z, CAST(min(d) AS BIGINT) AS depth FROM t GROUP BY a, b""")
def rec_depth(spark, sf_dir):
    found = star(spark, sf_dir).prove(atom("anc", X, Z), LINEAR, max_depth=3)
    return longs(found, x="X", z="Z", depth="depth")


@query(f"{TREE} SELECT b AS z FROM t WHERE a = 1")
def bc_bound(spark, sf_dir):
    return longs(star(spark, sf_dir).answers(atom("anc", 1, Z), LINEAR), z="Z")


@query(f"{TREE} SELECT a AS x FROM t WHERE b = 40")
def bc_bound_last(spark, sf_dir):
    return longs(star(spark, sf_dir).answers(atom("anc", X, 40), LINEAR), x="X")


# -- absence, negative facts, consistency ---------------------------------------------------


@query("""
SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def naf_simple(spark, sf_dir):
    return head(spark, sf_dir, [rule(atom("calm", C), atom("cust", C), absent("urgent", C))], atom("calm", C), c="C")


@query("SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def naf_wildcard(spark, sf_dir):
    return head(spark, sf_dir, [rule(atom("empty", O), atom("ord", O), absent("has_part", O, P))], atom("empty", O), o="O")


@query("""
SELECT o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def naf_multi(spark, sf_dir):
    rules = [
        rule(atom("empty", O), atom("ord", O), absent("has_part", O, P)),
        rule(atom("kept", O), atom("ord", O), absent("empty", O), absent("returned", O)),
    ]
    return head(spark, sf_dir, rules, atom("kept", O), o="O")


@query("""
WITH e AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT o FROM e)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT o FROM k)""")
def naf_three_strata(spark, sf_dir):
    rules = [
        rule(atom("empty", O), atom("ord", O), absent("has_part", O, P)),
        rule(atom("kept", O), atom("ord", O), absent("empty", O), absent("returned", O)),
        rule(atom("loose", C), atom("placed", C, O), absent("kept", O)),
    ]
    return head(spark, sf_dir, rules, atom("loose", C), c="C")


@query("""
SELECT DISTINCT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def naf_unlabelled(spark, sf_dir):
    return head(spark, sf_dir, [rule(atom("open", D), atom("doc", D), absent("labelled", D, ANY))], atom("open", D), d="D")


@query("SELECT doc_id AS d FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def contradictions(spark, sf_dir):
    return longs(consistency.contradictions(star(spark, sf_dir), "good", 1), d="a1")


def _enforced(spark, sf_dir, strategy):
    base = consistency.enforce(star(spark, sf_dir), strategy)
    parts = [base.relation(("good", 1, neg)).select(F.col("a1").alias("d"), F.lit(neg).alias("negated")) for neg in (False, True)]
    return parts[0].union(parts[1])


_SIGNS = "SELECT doc_id AS d, false AS negated FROM labels WHERE quality = 1 {0} UNION ALL SELECT doc_id, true FROM labels WHERE toxic = 1 {1}"
_BAD = "AND doc_id NOT IN (SELECT doc_id FROM labels WHERE {0} = 1)"


@query(_SIGNS.format("", _BAD.format("quality")))
def enforce_keep_positive(spark, sf_dir):
    return _enforced(spark, sf_dir, "keep_positive")


@query(_SIGNS.format(_BAD.format("toxic"), ""))
def enforce_keep_negative(spark, sf_dir):
    return _enforced(spark, sf_dir, "keep_negative")


@query(_SIGNS.format(_BAD.format("toxic"), _BAD.format("quality")))
def enforce_remove_both(spark, sf_dir):
    return _enforced(spark, sf_dir, "remove_both")


# -- the base: counts, files, novelty --------------------------------------------------------


def _small(spark, sf_dir) -> Base:
    whole = star(spark, sf_dir)
    return Base(spark, {k: whole.relation(k) for k in (("nation_in", 2, False), ("supp_in", 2, False), ("good", 1, False), ("good", 1, True))})


_FACTS = """
SELECT 'nation_in' AS predicate, [CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)] AS args FROM nation
UNION ALL SELECT 'supp_in', [CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)] FROM supplier
UNION ALL SELECT 'good', [CAST(doc_id AS VARCHAR)] FROM labels WHERE quality = 1
UNION ALL SELECT '~good', [CAST(doc_id AS VARCHAR)] FROM labels WHERE toxic = 1"""


@query(f"SELECT predicate, count(*) AS facts FROM ({_FACTS}) GROUP BY ROLLUP (predicate)")
def kb_stats(spark, sf_dir):
    return _small(spark, sf_dir).stats()


@query("""
SELECT '{"predicate":"nation_in","args":["' || n_nationkey || '","' || n_regionkey || '"]}' AS value FROM nation
UNION ALL SELECT '{"predicate":"good","args":["' || doc_id || '"],"negated":true}' FROM labels WHERE toxic = 1""")
def kb_export_jsonl(spark, sf_dir):
    whole = star(spark, sf_dir)
    return facts.export_jsonl(Base(spark, {k: whole.relation(k) for k in (("nation_in", 2, False), ("good", 1, True))}).facts())


@query("""
SELECT 'nation_in' AS predicate, false AS negated, CAST(0 AS BIGINT) AS part, CAST(to_json(list([CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)]
  ORDER BY CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR))) AS VARCHAR) AS facts FROM nation""")
def kb_export_json(spark, sf_dir):
    base = Base(spark, {("nation_in", 2, False): star(spark, sf_dir).relation(("nation_in", 2, False))})
    return facts.export_json(base.facts()).withColumn("part", F.col("part").cast("long"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s, s_name || ', ' || chr(34) || 'of' || chr(34) || ' ' || s_nationkey AS n FROM supplier")
def src_csv(spark, sf_dir):
    name = """concat('supp_in, ', s_suppkey, ' ,"', s_name, ', ""of"" ', s_nationkey, '"') AS value"""
    parts = tables.Parts(spark, "csv")
    read(spark, sf_dir, "supplier").selectExpr(name).write.text(f"{parts.base}/facts.csv")
    loaded = Base(spark).load(facts.read_facts(spark, f"{parts.base}/facts.csv"))
    return loaded.query(atom("supp_in", S, N)).select(F.col("S").alias("s"), F.col("N").alias("n"))


#: Facts of each predicate and sign, and a checksum of their first arguments.
_KEPT = f"SELECT ltrim(predicate, '~') AS predicate, predicate[1] = '~' AS negated, count(*) AS facts, CAST(sum(CAST(args[1] AS BIGINT)) AS BIGINT) AS first FROM ({_FACTS}) GROUP BY predicate"


def _kept(rows: DataFrame) -> DataFrame:
    first = F.sum(F.col("args")[0].cast("long")).alias("first")
    return rows.groupBy("predicate", "negated").agg(F.count("*").alias("facts"), first)


@query(_KEPT)
def src_parquet(spark, sf_dir):
    parts = tables.Parts(spark, "saved")
    facts.write_parquet(_small(spark, sf_dir).facts(), parts.base)
    return _kept(facts.read_facts(spark, parts.base, "parquet"))


@query(_KEPT)
def src_jsonl(spark, sf_dir):
    parts = tables.Parts(spark, "jsonl")
    facts.export_jsonl(_small(spark, sf_dir).facts()).write.text(f"{parts.base}/facts.jsonl")
    return _kept(facts.read_facts(spark, f"{parts.base}/facts.jsonl"))


@query(f"SELECT 'E' AS space, count(DISTINCT a) AS symbols FROM (SELECT unnest(args) AS a FROM ({_FACTS})) UNION ALL SELECT 'P', 3")
def kb_symbols(spark, sf_dir):
    return vectors.symbols_in(_small(spark, sf_dir).facts())


@query("""
SELECT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey)""")
def novelty_exact(spark, sf_dir):
    base = star(spark, sf_dir)
    rows = base.relation(("cust_in", 2, False))
    known = base.similar_exists(("supp_in", 2, False), rows, 0.95)
    return longs(rows.join(known, rows.columns, "left_anti"), c="a1", n="a2")


@query("""
SELECT DISTINCT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE
  c_custkey IN (SELECT s_suppkey FROM supplier) OR c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def novelty_half(spark, sf_dir):
    base = star(spark, sf_dir)
    return longs(base.similar_exists(("supp_in", 2, False), base.relation(("cust_in", 2, False)), 0.4), c="a1", n="a2")


# -- beliefs ---------------------------------------------------------------------------------

ITEMS = "quality / 2.0 + 0.25 AS weight, toxic = 1 AS negated"


@query(f"""
SELECT lang, source, round(p, 6) AS supp_pos, round(n, 6) AS supp_neg, round(p - n, 6) AS net_support,
  CASE WHEN p > 0 AND n > 0 THEN 'contradictory' WHEN p > 0 THEN 'consistent' WHEN n > 0 THEN 'denied' ELSE 'unknown' END AS state
FROM (SELECT lang, source, least(1.0, sum(CASE WHEN negated THEN 0 ELSE weight END)::DOUBLE) AS p,
  least(1.0, sum(CASE WHEN negated THEN weight ELSE 0 END)::DOUBLE) AS n
  FROM (SELECT lang, source, quality / 50.0::DOUBLE AS weight, toxic = 1 AS negated FROM labels JOIN documents USING (doc_id)) GROUP BY lang, source)
""")
def belief_state(spark, sf_dir):
    items = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    items = items.selectExpr("lang", "source", "quality / 50D AS weight", "toxic = 1 AS negated")
    found = beliefs.beliefs(beliefs.checked(items), ["lang", "source"])
    return longs(found, lang="lang", source="source", supp_pos="supp_pos", supp_neg="supp_neg", net_support="net_support", state="state")


@query("""
SELECT event_type, CAST(rank AS BIGINT) AS rank, event_id, round(weight, 6) AS weight FROM (
  SELECT event_type, event_id, value AS weight, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM events) WHERE rank <= 5""")
def belief_heaviest(spark, sf_dir):
    items = read(spark, sf_dir, "events").selectExpr("event_type", "event_id", "value AS weight")
    return longs(beliefs.heaviest(items, ["event_type"], ["event_id"], 5), event_type="event_type", rank="rank", event_id="event_id", weight="weight")


@query("""
SELECT user_id AS u, event_id AS e, round(value, 6) AS weight FROM events WHERE event_type = 'purchase'
ORDER BY value DESC, user_id, event_id LIMIT 20""")
def belief_answers(spark, sf_dir):
    items = read(spark, sf_dir, "events").withColumnRenamed("value", "weight")
    found = beliefs.weighted_answers(items, {"event_type": "purchase"}, ["user_id", "event_id"], 20)
    return longs(found, u="user_id", e="event_id", weight="weight")


@query("""
SELECT round(value, 6) AS weight FROM events WHERE event_type = 'purchase' AND event_id = (
  SELECT min(event_id) FROM events WHERE event_type = 'purchase')""")
def belief_ground(spark, sf_dir):
    """The weight of one literal, all of whose arguments are given."""
    items = read(spark, sf_dir, "events").withColumnRenamed("value", "weight")
    first = items.where("event_type = 'purchase'").agg(F.min("event_id")).first()[0]
    found = beliefs.weighted_answers(items, {"event_type": "purchase", "event_id": first}, [], 1)
    return longs(found, weight="weight")


# -- traces and streams ------------------------------------------------------------------------


@query("""
WITH RECURSIVE t AS (SELECT max(event_id) AS id FROM events UNION ALL SELECT id // 3 FROM t WHERE id > 0)
SELECT CAST(t.id AS VARCHAR) AS id FROM t JOIN events ON event_id = t.id""")
def trace_ancestors(spark, sf_dir):
    """Events as a trace in which each is led to by the one a third of its number."""
    events = read(spark, sf_dir, "events")
    parents = "if(event_id > 0, array(string(event_id div 3)), array()) AS parent_ids"
    last = events.agg(F.max("event_id")).first()[0]
    return traces.ancestors(events.selectExpr("string(event_id) AS id", parents), str(last))


@query(f"{TREE} SELECT a AS x, b AS z FROM t")
def live_closure(spark, sf_dir):
    """The suppliers' hierarchy arriving as a stream in three parts, folded into its closure."""
    parts = tables.Parts(spark, "live")
    star(spark, sf_dir).relation(("manages", 2, False)).repartition(3, "a2").write.parquet(f"{parts.base}/in")
    stream = spark.readStream.schema("a1 long, a2 long").option("maxFilesPerTrigger", 1).parquet(f"{parts.base}/in")
    live = LiveBase(Base(spark), LINEAR, {"manages": "a1 long, a2 long"}, f"{parts.base}/held")
    live.follow(stream, "manages", f"{parts.base}/checkpoint").awaitTermination()
    return longs(live.base.query(atom("anc", X, Z)), x="X", z="Z")


@query(f"""
WITH RECURSIVE m AS (SELECT s_suppkey // 3 AS a, s_suppkey AS b FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 10 <> 4),
t AS (SELECT a, b FROM m UNION SELECT m.a, t.b FROM m JOIN t ON m.b = t.a),
l AS (SELECT s_suppkey AS b FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM t))
SELECT a AS x, b AS z FROM t UNION ALL SELECT NULL, b FROM l""")
def live_deletes(spark, sf_dir):
    """The hierarchy arriving as a stream of inserts, and of deletes of every tenth link; who stands below nobody, by absence."""
    parts = tables.Parts(spark, "live")
    links = star(spark, sf_dir).relation(("manages", 2, False))
    links.selectExpr("*", "false AS gone").write.parquet(f"{parts.base}/in/part=0")
    links.where("a2 % 10 = 4").selectExpr("*", "true AS gone").write.parquet(f"{parts.base}/in/part=1")
    base = Base(spark).register("supp", read(spark, sf_dir, "supplier"), ["s_suppkey"])
    live = LiveBase(base, [*LINEAR, rule(atom("alone", X), atom("supp", X), absent("anc", ANY, X))], {"manages": "a1 long, a2 long"}, f"{parts.base}/held")
    for part in (0, 1):
        stream = spark.readStream.schema("a1 long, a2 long, gone boolean").parquet(f"{parts.base}/in/part={part}")
        live.follow(stream, "manages", f"{parts.base}/checkpoint-{part}", "gone").awaitTermination()
    alone = live.base.relation(("alone", 1, False)).select(F.lit(None).cast("long").alias("x"), F.col("a1").alias("z"))
    return longs(live.base.query(atom("anc", X, Z)), x="X", z="Z").union(alone)


# -- vectors ---------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"
_COS = f"{_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')}))"


def _flat(df: DataFrame) -> DataFrame:
    """``vec_id, pos, value``, values rounded."""
    return df.select("vec_id", F.posexplode("vec").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), (F.round("v", 6) + 0.0).alias("value")
    )


def _sql_flat(expression: str) -> str:
    return f"WITH {_E} SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round({expression}, 6) + CAST(0 AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM e)"


@query(_sql_flat("v[i] * v[(i - 2 + 64) % 64 + 1]"))
def vec_bind(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _flat(rows.withColumn("vec", V.bind(F.col("vec"), V.permute(F.col("vec"), 1))))


@query(_sql_flat("v[(i - 4 + 64) % 64 + 1]"))
def vec_permute(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir).withColumn("vec", V.permute(F.col("vec"), 3)))


@query(_sql_flat("CASE WHEN v[(i - 2 + 64) % 64 + 1] = 0 THEN NULL ELSE v[i] END"))
def vec_unbind(spark, sf_dir):
    other = V.permute(F.col("vec"), 1)
    return _flat(_vectors(spark, sf_dir).withColumn("vec", V.unbind(V.bind(F.col("vec"), other), other)))


@query(_sql_flat(f"2 * v[i] / (sqrt({_DOT.format('v', 'v').replace('lambda i: v[i] * v[i]', 'lambda j: 4 * v[j] * v[j]')}) + 1e-10)"))
def vec_normalize(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("vec", V.add(F.col("vec"), F.col("vec")))
    return _flat(rows.withColumn("vec", V.normalize(F.col("vec"))))


@query(f"WITH {_E} SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS pos, round(sum(v[i]), 6) + CAST(0 AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM e) GROUP BY label, i")
def vec_bundle(spark, sf_dir):
    rows = vectors.bundle(_vectors(spark, sf_dir), "vec", ["label"]).select(F.col("label").cast("long").alias("vec_id"), "vec")
    return _flat(rows).withColumnRenamed("vec_id", "label")


def _first(spark, sf_dir) -> list[float]:
    return _vectors(spark, sf_dir).where("vec_id = 0").first().vec


@query(f"""
WITH {_E} SELECT b.vec_id, round(abs({_COS}), 6) AS similarity FROM e a, e b WHERE a.vec_id = 0 ORDER BY abs({_COS}) DESC, b.vec_id LIMIT 20""")
def vec_similar(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "vec")
    return longs(vectors.similar(rows, _first(spark, sf_dir), 20), vec_id="vec_id", similarity="similarity")


@query(f"""
WITH {_E} SELECT query, CAST(rank AS BIGINT) AS rank, name, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS query, b.vec_id AS name, abs({_COS}) AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY abs({_COS}) DESC, b.vec_id) AS rank
  FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def vec_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "vec")
    found = vectors.cleanup(asked, rows.select(F.col("vec_id").alias("name"), "vec"), k=5, others=True)
    return longs(found, query="query", rank="rank", name="name", similarity="similarity")


@query(f"""
WITH {_E} SELECT a.vec_id, max(abs({_COS})) < 0.45 AS novel FROM e a, e b
WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def vec_novelty(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "vec")
    near = vectors.cleanup(asked, rows.select(F.col("vec_id").alias("name"), "vec"), k=1, others=True)
    return near.select(F.col("query").alias("vec_id"), (F.col("similarity") < 0.45).alias("novel"))


@query(f"""
WITH {_E} SELECT query, CAST(rank AS BIGINT) AS rank, name, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS query, b.vec_id AS name, ({_COS} + 1) / 2 AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
  FROM e a, e b WHERE a.vec_id % 20 = 0) WHERE rank <= 3 AND s >= 0.6""")
def vec_bipolar(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "vec")
    found = vectors.cleanup(asked, rows.select(F.col("vec_id").alias("name"), "vec"), 3, 0.6, bipolar=True)
    return longs(found, query="query", rank="rank", name="name", similarity="similarity")


@query("""
SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS query, 'r' || n_regionkey AS name FROM nation""")
def vec_decode_argument(spark, sf_dir):
    """Facts encoded as vectors, and their second argument read off again."""
    size = 512
    rows = read(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS a", "concat('r', n_regionkey) AS b", "cast(n_nationkey AS string) AS id")
    long = rows.select("id", F.lit("nation_in").alias("predicate"), F.array("a", "b").alias("args"))
    noisy = vectors.argument(vectors.encode(long, size), 2, size).select(F.col("id").alias("query"), F.col("arg").alias("vec"))
    regions = vectors.codebook(rows.select("b"), "E", size).select("name", "vec")
    return vectors.cleanup(noisy, regions).select("query", "name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestar import model_queries  # noqa: F401  (adds its own to the catalogue)

    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    from lodestar import model_queries  # noqa: F401

    return {name: sql.strip() for name, (_, sql) in CATALOGUE.items() if sql}
