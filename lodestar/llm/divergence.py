"""How far the sources of a language diverge in their use of terms, by joint count histograms.

Counts of terms are smoothed to integer parts of a thousand million, and two sources differ
by the sum of the parts' differences over all kept terms. That depends on a term only
through its two counts, so for each pair of sources the distinct (count, count) combinations
are tallied, and the difference is evaluated once a combination. Combinations with a zero
are never listed term by term: they follow from how often each source has a count, less what
the pair has in common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept, settle, trimmed

LEAST_DOCS = 30
SMOOTHING = 5
PARTS = 1_000_000_000
TOP = 50
#: Letters stay, A-Z lower-cased; every byte of a character beyond ASCII is one of a letter.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and entries that a task holds before it passes them on.
BLOCK = 1 << 20
HELD = 400_000
#: Pairs of one term's sources listed at a time within a task.
PAIRS = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in blocks of bounded size."""
    line, at = text.translate(LETTERS), 0
    while at < len(line):
        end = line.find(b" ", at + BLOCK)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs``: occurrences and documents of every term in every group; ``term`` is in UTF-8."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("divergence", lambda: None)
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, in_docs) in held.items():
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64()), pa.array([in_docs[t] for t in counts], pa.int64())],
                    ["lang", "source", "term", "count", "docs"],
                )
            held.clear()

        for b in batches:
            for lang, source, text in zip(*b.columns, strict=True):
                group = (lang.as_py(), source.as_py())
                seen: set[bytes] = set()
                for block in terms(text.as_py()):
                    counts, in_docs = held.setdefault(group, (Counter(), Counter()))
                    before = len(counts)
                    counts.update(block)
                    new = set(block) - seen
                    in_docs.update(new)
                    seen |= new
                    size += len(counts) - before
                    if size > HELD:
                        yield from emitted()
                        size = 0
        yield from emitted()

    own = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    rows = own.mapInArrow(trimmed(counted), "lang string, source string, term binary, count bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def joint_counts(cells: DataFrame) -> DataFrame:
    """``lang, s, t, a, b, n``: for sources s < t, how many terms have counts a > 0 in s and b > 0 in t.

    A term's cells come one after another in a task; tasks add up their pairs, so what is
    shuffled are combinations, not terms.
    """
    names = ["lang", "s", "t", "a", "b"]

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("divergence", lambda: None)
        waiting: list[tuple] = []
        listed = 0
        total: pd.DataFrame | None = None

        def merged() -> pd.DataFrame:
            nonlocal waiting, listed
            parts = [pd.DataFrame(dict(zip(names, part, strict=True))).groupby(names, sort=False).size().rename("n").reset_index() for part in joined(waiting)]
            waiting, listed = [], 0
            whole = pd.concat(([total] if total is not None else []) + parts)
            return whole.groupby(names, sort=False)["n"].sum().reset_index()

        def joined(parts: list[tuple]) -> list[tuple]:
            if not parts:
                return []
            langs = np.repeat(np.array([p[0] for p in parts], object), [len(p[1]) for p in parts])
            return [(langs, *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)))]

        def pairs(lang: str, source: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
            first = 0
            while first < len(source) - 1:  # so many sources at a time that their pairs fit
                step = max(1, PAIRS // len(source))
                i = np.arange(first, min(first + step, len(source) - 1))
                left = np.repeat(i, len(source) - 1 - i)
                right = np.concatenate([np.arange(x + 1, len(source)) for x in i])
                yield lang, source[left], source[right], count[left], count[right]
                first += step

        run: tuple | None = None
        sources: list = []
        counts: list = []

        def closed() -> Iterator[pd.DataFrame]:
            nonlocal listed, total
            if len(sources) > 1:
                for part in pairs(run[0], np.array(sources, object), np.array(counts, np.int64)):
                    waiting.append(part)
                    listed += len(part[1])
                    if listed > PAIRS:
                        total = merged()
                        if len(total) > PAIRS:
                            yield total
                            total = None

        for b in batches:
            for lang, term, source, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, term) != run:
                    for done in closed():
                        yield pa.RecordBatch.from_pandas(done, preserve_index=False)
                    run, sources, counts = (lang, term), [], []
                sources.append(source)
                counts.append(count)
        for done in closed():
            yield pa.RecordBatch.from_pandas(done, preserve_index=False)
        if waiting:
            total = merged()
        if total is not None and len(total):
            yield pa.RecordBatch.from_pandas(total, preserve_index=False)

    rows = cells.select("lang", "term", "source", "count").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = rows.mapInArrow(trimmed(tallied), "lang string, s string, t string, a bigint, b bigint, n bigint")
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def _part(count: str, total: str, kept_terms: str = "v") -> Column:
    """1 + floor(PARTS * (count + 5) / (total + 5 * terms)), in decimals so that nothing overflows."""
    above = f"cast({count} + {SMOOTHING} as decimal(24,0)) * {PARTS}BD"
    return F.expr(f"1 + ({above}) div cast({total} + {SMOOTHING} * {kept_terms} as decimal(24,0))")


def tallies(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lang, s, t, a, b, n`` for every pair, with the combinations that hold a zero."""
    joint = settle(joint_counts(cells), "joint")
    has = settle(cells.groupBy("lang", "source", "count").agg(F.count("*").alias("n")), "histogram")
    zero = F.lit(0).cast("long")

    def spread(rows: DataFrame, *entries: tuple) -> DataFrame:
        listed = F.array(*(F.struct(a.alias("a"), b.alias("b"), n.alias("n")) for a, b, n in entries))
        return rows.select("lang", "s", "t", F.explode(listed).alias("e")).select("lang", "s", "t", "e.*")

    a, b, n, count = F.col("a"), F.col("b"), F.col("n"), F.col("count")
    lefts = pairs.join(has.withColumnRenamed("source", "s"), ["lang", "s"])
    rights = pairs.join(has.withColumnRenamed("source", "t"), ["lang", "t"])
    every = (
        spread(joint, (a, b, n), (a, zero, -n), (zero, b, -n), (zero, zero, n))
        .union(spread(lefts, (count, zero, n), (zero, zero, -n)))
        .union(spread(rights, (zero, count, n), (zero, zero, -n)))
        .union(spread(pairs, (zero, zero, F.col("v"))))
    )
    return every.groupBy("lang", "s", "t", "a", "b").agg(F.sum("n").alias("n")).where("n != 0")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group that occurs.

    Part ``pair`` holds every other source of the language with the summed difference, part
    ``term`` the ``top`` terms that the group has more of than its language. Null text, lang
    and source are read as ''. Each language keeps the terms in at least ``least_docs`` of its
    documents; without any, pairs differ by 0 and there are no terms. A repeated row counts
    as one more document. An empty table gives an empty result; extra columns are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    docs = docs.select(*names, text.alias("text"))
    counts = settle(term_counts(docs), "counts")
    chosen = settle(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs).drop("docs"),
        "chosen",
    )
    cells = settle(counts.drop("docs").join(chosen, ["lang", "term"]), "cells")
    langs = chosen.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    none = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = settle(groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "v", "lang_n"))), "groups")

    one = groups.select("lang", F.col("source").alias("s"), F.col("n").alias("n_s"), "v")
    other = groups.select("lang", F.col("source").alias("t"), F.col("n").alias("n_t"))
    pairs = settle(one.join(other, "lang").where("s < t"), "pairs")
    cell = tallies(cells, pairs.select("lang", "s", "t", "v")).join(pairs, ["lang", "s", "t"])
    differ = F.when(F.col("v") > 0, F.abs(_part("a", "n_s") - _part("b", "n_t")) * F.col("n")).otherwise(none)
    apart = cell.groupBy("lang", "s", "t").agg(F.sum(differ).alias("value"))
    apart = settle(pairs.select("lang", "s", "t").join(apart, ["lang", "s", "t"], "left").withColumn("value", F.coalesce("value", none)), "apart")
    both = apart.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value").union(apart.select("lang", "t", "s", "value"))

    used = cells.join(groups, ["lang", "source"]).withColumn("p", _part("count", "n")).withColumn("q", _part("total", "lang_n"))
    more = used.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    by_pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    by_term = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked.alias("rank")).where(F.col("rank") <= top)
    return by_pair.union(by_term)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + (CAST({PARTS} AS HUGEINT) * (n + {SMOOTHING})) // (sum(n) OVER grp + {SMOOTHING} * count(*) OVER grp) AS p,
  1 + (CAST({PARTS} AS HUGEINT) * (total + {SMOOTHING})) // (sum(total) OVER grp + {SMOOTHING} * count(*) OVER grp) AS q
  FROM c WINDOW grp AS (PARTITION BY lang, source)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b
  ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b
  ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
