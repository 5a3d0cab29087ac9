"""Facts from and to files: CSV, JSON lines, Parquet and whole-base JSON.

The long form of facts is ``predicate string, args array<string>, negated boolean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "predicate string, args array<string>, negated boolean"


#: A cell after its comma: quoted from its first character on, with doubled quotes in it, or plain.
CELL = r',(?:"(?:[^"]|"")*+"[^,]*+|[^,]*+)'


def cells_of(line: Column) -> Column:
    """The trimmed cells of a line of CSV; a cell that begins with a quote may hold commas and doubled quotes."""

    def plain(cell: Column) -> Column:
        body = F.substring(cell, 2, 1 << 30)
        inner = F.regexp_replace(F.regexp_extract(body, r'^"((?:[^"]|"")*+)"', 1), '""', '"')
        rest = F.regexp_extract(body, r'^"(?:[^"]|"")*+"([^,]*+)$', 1)
        return F.trim(F.when(body.rlike(r'^"(?:[^"]|"")*+"'), F.concat(inner, rest)).otherwise(body))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(0)), plain)


def read_csv(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """Facts from lines of comma-parted cells, of any width; cells are trimmed, blank lines skipped.

    Cells may be quoted, commas and doubled quotes inside, but end with their line, so that files
    can be split. Without ``predicate`` the first cell names it, and a line of fewer than two
    cells raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(cells_of(F.col("value")).alias("cells"))
    if predicate is not None:
        return lines.select(F.lit(predicate).alias("predicate"), F.col("cells").alias("args"), F.lit(False).alias("negated"))
    few = F.raise_error(F.concat(F.lit("at least 2 columns are needed: "), F.array_join("cells", ",")))
    checked = F.when(F.size("cells") < 2, few.cast("array<string>")).otherwise(F.col("cells"))
    return lines.select(checked.alias("cells")).select(
        F.col("cells")[0].alias("predicate"),
        F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("args"),
        F.lit(False).alias("negated"),
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON lines with ``predicate`` and ``args``; malformed lines raise, blank ones are skipped."""
    rows = spark.read.schema("predicate string, args array<string>, negated boolean").option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.lit("each line needs a predicate and args"))
    return rows.select(
        F.when(F.col("predicate").isNull() | F.col("args").isNull(), missing.cast("string")).otherwise(F.col("predicate")).alias("predicate"),
        "args",
        F.coalesce("negated", F.lit(False)).alias("negated"),
    )


def read_facts(spark: SparkSession, path: str, kind: str = "auto", predicate: str | None = None) -> DataFrame:
    """Facts by file ending or ``kind``: csv, jsonl (or json), parquet."""
    kind = path.rsplit(".", 1)[-1].lower() if kind == "auto" else kind
    if kind == "csv":
        return read_csv(spark, path, predicate)
    if kind in ("jsonl", "json"):
        return read_jsonl(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no such kind of facts: {kind}")


def write_parquet(facts: DataFrame, path: str) -> None:
    """Save facts, a folder for each predicate, so that a later read of one predicate prunes the others."""
    facts.write.mode("overwrite").partitionBy("predicate").parquet(path)


#: Facts in one JSON text at about most.
EXPORTED = 10_000


def export_json(facts: DataFrame) -> DataFrame:
    """``predicate, negated, part, facts``: JSON texts of about ``EXPORTED`` facts at most, in order of their arguments.

    A predicate with more facts has several parts, so none is gathered whole.
    """
    sizes = facts.groupBy("predicate", "negated").agg((F.count("*") / EXPORTED + 1).cast("int").alias("parts"))
    dealt = facts.join(sizes, ["predicate", "negated"]).withColumn("part", F.pmod(F.xxhash64("args"), "parts").cast("int"))
    one = F.to_json(F.sort_array(F.collect_list("args"))).alias("facts")
    return dealt.groupBy("predicate", "negated", "part").agg(one)


def export_jsonl(facts: DataFrame) -> DataFrame:
    """``value``: a JSON line for each fact; negative ones say so, so that ``read_jsonl`` gives the same facts."""
    sign = F.when(F.col("negated"), F.lit(True)).alias("negated")
    return facts.select(F.to_json(F.struct("predicate", "args", sign)).alias("value"))


def long_form(relation: DataFrame, predicate: str, negated: bool = False) -> DataFrame:
    """A relation's rows as facts."""
    args = F.array(*(F.col(c).cast("string") for c in relation.columns))
    return relation.select(F.lit(predicate).alias("predicate"), args.alias("args"), F.lit(negated).alias("negated"))
