"""Weighted evidence for and against literals, added up to beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked(items: DataFrame) -> DataFrame:
    """Items whose weight lies in 0 to 1, whose priority isn't negative and whose kind is FACT; others raise on use."""
    fine = F.col("weight").between(0, 1)
    if "priority" in items.columns:
        fine = fine & (F.coalesce("priority", F.lit(0.0)) >= 0)
    if "kind" in items.columns:
        fine = fine & (F.col("kind") == "FACT")
    bad = F.raise_error(F.lit("an item needs a weight in 0 to 1, a priority of 0 or more and kind FACT")).cast("double")
    return items.withColumn("weight", F.when(F.coalesce(fine, F.lit(False)), F.col("weight")).otherwise(bad))


def evidence(items: DataFrame, by: list[str], weight: str = "weight", negated: str = "negated") -> DataFrame:
    """``<by>, pos, neg``: the weights for and against each literal, added up."""
    own = [F.when(~F.col(negated), F.col(weight)).otherwise(0.0), F.when(F.col(negated), F.col(weight)).otherwise(0.0)]
    return items.groupBy(*by).agg(F.sum(own[0]).alias("pos"), F.sum(own[1]).alias("neg"))


def added(sums: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Evidence with that of later items added: only the new items are gone through, the sums are joined."""
    return sums.union(more.select(*sums.columns)).groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def judged(sums: DataFrame, by: list[str]) -> DataFrame:
    """``<by>, supp_pos, supp_neg, net_support, state`` from evidence: at most 1 each.

    ``state`` is consistent (only for), contradictory (both), unknown (neither) or denied (only against).
    """
    one = F.lit(1.0)
    found = sums.select(*by, F.least(one, "pos").alias("supp_pos"), F.least(one, "neg").alias("supp_neg"))
    pos, neg = F.col("supp_pos") > 0, F.col("supp_neg") > 0
    state = F.when(pos & neg, "contradictory").when(pos, "consistent").when(neg, "denied").otherwise("unknown")
    return found.withColumn("net_support", F.col("supp_pos") - F.col("supp_neg")).withColumn("state", state)


def beliefs(items: DataFrame, by: list[str], weight: str = "weight", negated: str = "negated") -> DataFrame:
    """What items say of each literal: see ``judged``. Weights aren't negative, so the order of the sum doesn't matter."""
    return judged(evidence(items, by, weight, negated), by)


def weighted_answers(items: DataFrame, bound: dict[str, object], free: list[str], k: int) -> DataFrame:
    """Items that agree with the bound columns: the free columns and ``weight``, heaviest first, at most ``k``."""
    rows = items
    for column, value in bound.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.select(*free, "weight").orderBy(F.desc("weight"), *free).limit(k)


def heaviest(items: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The ``k`` heaviest items of each group, with their ``rank``."""
    best = Window.partitionBy(*by).orderBy(F.desc("weight"), *order)
    return items.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
