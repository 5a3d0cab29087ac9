"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs after learned rotations (iterative quantisation on a bounded sample), cut
into 16-bit substrings, each indexed. By the pigeonhole principle a code within a Hamming
radius of a query agrees with it in some substring within that radius's share, so probing
every substring's buckets within the share retrieves every code within the radius. Buckets
are probed by enumerating the values within the share, or, where these are more than the
buckets there are, by comparing with the buckets' values. What the codes let through is
ranked by true distances. Vectors lie in shards of bounded size, each with its own index;
queries visit all shards in blocks, and the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

BITS = 256
SUBSTRING = 16
#: Rows that the rotations and the radius are fitted on at most: those least by hash of the id.
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
#: The share of the sample's true neighbours that lie within the radius.
COVERED = 0.99
ROUNDS = 20
#: Components in a shard of vectors, and in a block of queries, at about most.
SHARD_VALUES = 1 << 21
BLOCK_VALUES = 1 << 21
#: Vectors from which a shard of its own is worth while.
LEAST_ROWS = 1024


@dataclass
class Codes:
    """``mean`` and ``turns`` (dimension by bits) make codes; ``radius`` is searched first."""

    mean: np.ndarray
    turns: np.ndarray
    radius: int = 0

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        signs = (vectors - self.mean) @ self.turns > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u2")


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learn(vectors: np.ndarray, k: int, bits: int = BITS, seed: int = 1) -> Codes:
    """Fit rotations so that signs lose little: alternate signs and the rotation nearest to them.

    Fewer dimensions than bits take several rotations from different starts; of more
    dimensions the principal ones are kept.
    """
    rng = np.random.default_rng(seed)
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    width = min(vectors.shape[1], bits)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :width]
    flat, turns = centred @ axes, []
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        turns.append(axes @ turn)
    codes = Codes(mean, np.hstack(turns)[:, :bits])
    packed = codes.encode(vectors)
    near = []
    for i in range(min(SAMPLE_QUERIES, len(vectors))):
        true = np.argsort(((vectors - vectors[i]) ** 2).sum(axis=1), kind="stable")
        near.append(distances(packed[true[true != i][:k]], packed[i]))
    if near and sum(map(len, near)):
        codes.radius = int(np.quantile(np.concatenate(near), COVERED))
    return codes


@lru_cache(maxsize=None)
def flips(bits: int) -> np.ndarray:
    """The values of a substring with at most so many bits set, which flip it to all values within that distance."""
    every = np.arange(1 << SUBSTRING, dtype=np.uint32)
    return every[np.bitwise_count(every) <= bits].astype(np.uint16)


class Index:
    """One shard: per substring, the rows in order of its value and where each value's bucket begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, begins, counts = np.unique(column[order], return_index=True, return_counts=True)
            self.tables.append((order, values, begins, counts))

    def probed(self, j: int, value: int, bits: int) -> np.ndarray:
        """The rows whose ``j``-th substring differs from a value in at most so many bits."""
        order, values, begins, counts = self.tables[j]
        if bits < 0 or not len(values):
            return order[:0]
        if len(near := flips(min(bits, SUBSTRING))) < len(values):
            wanted = near ^ np.uint16(value)
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            at = at[values[at] == wanted]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ np.uint16(value)) <= bits)
        first, n = begins[at], counts[at]
        return order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes lie within the radius."""
        share, rest = divmod(radius, len(self.tables))
        marked = np.zeros(len(self.codes), bool)
        for j in range(len(self.tables)):
            # Substrings after the first rest + 1 need one bit less.
            marked[self.probed(j, int(code[j]), share if j <= rest else share - 1)] = True
        rows = np.flatnonzero(marked)
        return rows[distances(self.codes[rows], code) <= radius]

    def nearest(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        """Rows within the radius, which grows until there are ``k`` or all."""
        while True:
            rows = self.within(code, radius)
            if len(rows) >= min(k, len(self.codes)):
                return rows
            radius += len(self.tables)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part."""
    x = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & fine).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = settle(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0))


def neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearness is Euclidean distance in double precision, ties to the smaller id. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do rows without
    an id or of a length other than the commonest, which have no distance to the others. Rows
    that share an id count once, by the least vector. A query has all candidates if there are
    fewer than ``k``. Columns other than these two are left out.
    """
    rows = usable(vectors, id_col, vector_col)
    sample = [r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()]
    kinds = "query_id long, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = learn(np.array(sample), k)
    asked = F.col("id") % every == 0
    total, queries = rows.agg(F.count("*"), F.count_if(asked)).first()
    # A row is copied to each block of queries, and a query to each shard; small tables are still dealt to many tasks.
    tasks = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_ROWS)
    shards = max(1, -(-total * len(sample[0]) // SHARD_VALUES), tasks)
    blocks = max(1, -(-queries * len(sample[0]) // BLOCK_VALUES))

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    held = own.withColumn("block", spread(blocks))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    asking = rows.where(asked).withColumn("block", block).withColumn("shard", spread(shards))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = list(_search(left, right, codes, k))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    # Each group holds a shard and a block of queries, both of bounded size.
    best = held.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInPandas(searched, kinds)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(left: pd.DataFrame, right: pd.DataFrame, codes: Codes, k: int) -> Iterator[tuple]:
    """(query's id, ids, distances) of the nearest in one shard, for each query of a block."""
    if not len(left) or not len(right):
        return
    ids, vectors = left["id"].to_numpy(np.int64), np.stack(left["vector"].to_numpy())
    index = Index(codes.encode(vectors))
    asked = np.stack(right["vector"].to_numpy())
    for query, vector, code in zip(right["id"].to_numpy(np.int64), asked, codes.encode(asked), strict=True):
        rows = index.nearest(code, codes.radius, k + 1)
        rows = rows[ids[rows] != query]
        away = np.sqrt(((vectors[rows] - vector) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], away))[:k]
        yield np.full(len(best), query), ids[rows[best]], away[best]
