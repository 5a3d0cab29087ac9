"""Joins on a band: pairs whose values differ by no less and no more than given."""

from __future__ import annotations

from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.tables import settle

#: Rows of one side in a bucket beyond which it is split.
SPLIT = 50_000
#: Buckets of a band without an end.
OPEN_BUCKETS = 64
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _number(df: DataFrame, column: str) -> tuple[Column, bool]:
    """A value as a number to be dealt by, and whether it is whole; times are in microseconds, days in days."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp":
        return F.unix_micros(column), True
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp")), True
    if kind == "date":
        return F.unix_date(column).cast("long"), True
    if kind in WHOLE:
        return F.col(column).cast("long"), True
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.col(column).cast("double"), False
    raise TypeError(f"{column}: no band over {kind}")


def has_band(left: DataFrame, right: DataFrame, a: str, b: str) -> bool:
    """Whether the columns can be dealt into buckets: numbers, times or days on both sides."""
    try:
        _number(left, a), _number(right, b)
    except TypeError:
        return False
    return True


def _bound(x: Any, days: bool) -> Any:
    if isinstance(x, timedelta):
        return x / timedelta(days=1) if days else x // timedelta(microseconds=1)
    return x


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, low: Any, high: Any) -> DataFrame:
    """All columns of both for pairs with ``low <= right.b - left.a <= high``; a bound that is None is no bound.

    The sides share no column name. Values are dealt into buckets as wide as the band: a row of
    the right stands in one, a row of the left in the two or three that its band meets, and the
    join is one of equal buckets. Buckets with more than ``SPLIT`` rows of the right are split,
    the left's rows of them copied to each part. Without one of the bounds the result grows
    with the square of the rows anyway; buckets are then ranges of equal size of the right, and
    a row of the left is copied to all on its side. Nulls and NaN meet nothing.
    """
    days = dict(left.dtypes)[a] == "date"
    low, high = _bound(low, days), _bound(high, days)
    (x, whole), (y, other) = _number(left, a), _number(right, b)
    whole = whole and other
    rows, others = left.withColumn("_x", x), right.withColumn("_y", y)
    rows, others = (df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) for df, c in ((rows, "_x"), (others, "_y")))
    if low is None or high is None:
        share = [i / OPEN_BUCKETS for i in range(1, OPEN_BUCKETS)]
        cuts = sorted(set(others.select(F.col("_y").cast("double").alias("y")).approxQuantile("y", share, 0.01)))
        edges = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>")
        number = lambda v: F.size(F.filter(edges, lambda c: c < v.cast("double")))
        least = number(F.col("_x") + low) if low is not None else F.lit(0)
        most = number(F.col("_x") + high) if high is not None else F.lit(len(cuts))
        place = number(F.col("_y"))
    else:
        width, more = high - low or 1, 1
        at = lambda v: F.floor(v / F.lit(float(width))).cast("long")
        if whole and isinstance(width, int):
            # Whole numbers have no rounding for a bucket more on each side to make up for.
            more, at = 0, lambda v: ((v - F.pmod(v, F.lit(width))) / F.lit(width)).cast("long")
        least, most, place = at(F.col("_x") + low) - more, at(F.col("_x") + high) + more, at(F.col("_y"))
    rows = rows.withColumn("_bucket", F.explode(F.sequence(least, most)))
    others = others.withColumn("_bucket", place)
    hot = others.groupBy("_bucket").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    rows = rows.join(hot, "_bucket", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    salt = F.pmod(F.xxhash64(*right.columns), parts).cast("int")
    others = others.join(hot, "_bucket", "left").withColumn("_part", salt).drop("_parts")
    fits = F.lit(True)
    if low is not None:
        fits = fits & (F.col("_y") >= F.col("_x") + F.lit(low))
    if high is not None:
        fits = fits & (F.col("_y") <= F.col("_x") + F.lit(high))
    return rows.join(others, ["_bucket", "_part"]).where(fits).select(*left.columns, *right.columns)


#: Types whose values compare as they are sorted.
SORTED = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "string"}


def can_rank(left: DataFrame, right: DataFrame, a: str, b: str) -> bool:
    """Whether columns are of one type, or both whole numbers, that ``counted_beyond`` can put in order."""
    one, other = dict(left.dtypes)[a], dict(right.dtypes)[b]
    return {one, other} <= WHOLE or (one == other and (one in SORTED or one.startswith("decimal")))


def counted_beyond(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str, over: str, op: str) -> DataFrame:
    """``*by, _total``: how many different ``over`` of the right have ``right.b op left.a`` for a row of the group.

    Groups that meet no row of the right are left out, and a null ``over`` isn't counted. No pair
    is made: a group's farthest value says whom it meets, a counted thing's nearest value by whom
    it is met, so both are put in one order and numbers are added up along it, first within
    ranges of values, then over the ranges. Nulls and NaN meet nothing.
    """
    up = op in ("<", "<=")
    fine = lambda df, c: df.where(F.col(c).isNotNull() & (~F.isnan(c) if dict(df.dtypes)[c] in ("float", "double") else F.lit(True)))
    kind = "bigint" if {dict(left.dtypes)[a], dict(right.dtypes)[b]} <= WHOLE else dict(left.dtypes)[a]
    farthest, nearest = (F.max, F.min) if up else (F.min, F.max)
    groups = fine(left.select(*by, F.col(a).cast(kind).alias("_v")), "_v").groupBy(*by).agg(farthest("_v").alias("_v"))
    things = fine(right.select(F.col(over).alias("_over"), F.col(b).cast(kind).alias("_v")), "_v").groupBy("_over").agg(nearest("_v").alias("_v"))
    # A thing without a name is met, but not counted.
    steps = things.groupBy("_v").agg(F.count("_over").alias("_n"), F.count("*").alias("_all"))
    asked = groups.select("_v").distinct().select("_v", F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_all"))
    values = steps.union(asked).groupBy("_v").agg(F.sum("_n").alias("_n"), F.sum("_all").alias("_all"))
    # Settled with the number of its range, so that both passes see the same ranges.
    dealt = values.repartitionByRange("_v" if up else F.desc("_v")).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("_n").alias("_n"), F.sum("_all").alias("_all"))  # a row for each range
    starts = sums.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_all")))
    within = Window.partitionBy("_range").orderBy("_v" if up else F.desc("_v"))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow if op in ("<=", ">=") else -1)
    placed = dealt.join(F.broadcast(starts), "_range").select(
        "_v", *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{c}_before")).alias(c) for c in ("_n", "_all"))
    )
    return groups.join(placed.where("_all > 0"), "_v").select(*by, F.col("_n").alias("_total"))
