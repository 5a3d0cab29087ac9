"""Centroid clustering over exact integers, with Elkan's bounds.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of
the distance to each; centroids that a bound, or half the distance between two centroids,
shows to be farther are skipped. Bounds are rounded outwards and a centroid is skipped only
if it is strictly farther, so ties are always computed and go to the smaller number. What is
computed is the exact integer square of the distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.tables import drop

from .shared import kept, settle

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Integers beyond this are held at it: the square of such a distance is no long any more.
LARGEST = 1 << 61
MOST = (1 << 63) - 1
#: Up to this sum of two components, squares of distances are exact in doubles.
PLAIN = 1 << 23
#: Outward rounding of doubles, wider than the error of a root and a sum.
SLACK = 2.0**-48


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = COMPONENTS) -> DataFrame:
    """``id, v``: vectors of exactly ``size`` components, none null or not finite, as floor(256 * x)."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(LARGEST)
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(limit)), F.lit(-limit))))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x")).where((F.size("x") == size) & finite).select("id", whole.alias("v"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors with the ``k`` least hashes of their ids, in that order; rows of one id in order of the vector."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    found = rows.where("id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64) if found else np.zeros((0, 0), np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid: whole doubles where they fit, else Python integers."""
    if not len(v) or int(np.abs(v).max()) + int(np.abs(c).max()) <= PLAIN:
        d = (v - c).astype(np.float64)
        return np.einsum("ij,ij->i", d, d)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64) * (1 + SLACK)
    near = x.astype(np.float32)
    return np.where(near < x, np.nextafter(near, np.float32(np.inf)), near)


def _down(x: np.ndarray) -> np.ndarray:
    x = np.maximum(np.asarray(x, np.float64) * (1 - SLACK), 0)
    near = x.astype(np.float32)
    return np.where(near > x, np.nextafter(near, np.float32(0)), near)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Step:
    """One assignment: centroids, how far each moved since the last one, and half the distances between them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids, k = centroids, len(centroids)
        moved = [squares(centroids[j : j + 1], before[j])[0] if before is not None else 0 for j in range(k)]
        self.moved = _up(_roots(np.array(moved, object))).astype(np.float64)
        between = [squares(centroids, c) for c in centroids]
        self.half = _down(np.array([_roots(np.asarray(row)) for row in between]).reshape(k, k) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows' new centroids and bounds, and how many distances were computed."""
        own, upper = own.copy(), _up(upper.astype(np.float64) + self.moved[own])
        lower = _down(lower.astype(np.float64) - self.moved)
        open_ = np.flatnonzero(~(upper < self.nearest[own]))
        if not len(open_):
            return own, upper, lower, 0
        rows, start = v[open_], own[open_]
        best = np.empty(len(open_), object if int(np.abs(rows).max()) + int(np.abs(self.centroids).max()) > PLAIN else np.float64)
        for j in np.unique(start):
            at = np.flatnonzero(start == j)
            best[at] = squares(rows[at], self.centroids[j])
        tight, low = _up(_roots(best)), lower[open_]
        low[np.arange(len(open_)), start] = _down(_roots(best))
        asked = ~(tight[:, None] < low) & ~(tight[:, None] < self.half[start])
        asked[np.arange(len(open_)), start] = False
        chosen = start.copy()
        for j in range(len(self.centroids)):
            at = np.flatnonzero(asked[:, j])
            if len(at):
                d = squares(rows[at], self.centroids[j])
                low[at, j] = _down(_roots(d))
                closer = (d < best[at]) | ((d == best[at]) & (j < chosen[at]))
                best[at[closer]], chosen[at[closer]] = d[closer], j
        own[open_], upper[open_], lower[open_] = chosen, _up(_roots(best)), low
        return own, upper, lower, len(open_) + int(asked.sum())


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1)))


STATE = "id {}, v array<bigint>, own int, upper float, lower array<float>, computed bigint"


def _assigned(state: DataFrame, step: Step, kind: str) -> DataFrame:
    """The rows with their centroids and bounds after a step; rows without bounds yet have none."""
    k, known = len(step.centroids), "own" in state.columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("centroids", lambda: None)
        for b in batches:
            if not b.num_rows:
                continue
            v, n = _matrix(b.column(1)).astype(np.int64), b.num_rows
            own = b.column(2).to_numpy() if known else np.zeros(n, np.int32)
            upper = b.column(3).to_numpy() if known else np.full(n, np.inf, np.float32)
            lower = _matrix(b.column(4)) if known else np.zeros((n, k), np.float32)
            own, upper, lower, computed = step.assign(v, own, upper, lower)
            made = np.zeros(n, np.int64)
            made[0] = computed
            columns = [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(upper.astype(np.float32)), _lists(lower.astype(np.float32)), pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "own", "upper", "lower", "computed"])

    return state.mapInArrow(judged, STATE.format(kind))


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of every centroid's mean; one without vectors stays.

    Tasks add up their own rows, in two halves of 31 bits and the rest so that no sum
    overflows; Spark adds up the tasks. The driver sees a number for each component.
    """
    k, size = centroids.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("centroids", lambda: None)
        high, low, n = np.zeros((k, size), np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            own, v = b.column(0).to_numpy(), _matrix(b.column(1)).astype(np.int64)
            for j in np.unique(own):
                mine = v[own == j]
                high[j] += (mine >> 31).sum(axis=0)
                low[j] += (mine & 0x7FFFFFFF).sum(axis=0)
                n[j] += len(mine)
        at = np.flatnonzero(n)
        if len(at):
            columns = [pa.array(at.astype(np.int32)), pa.array(n[at]), _lists(high[at]), _lists(low[at])]
            yield pa.RecordBatch.from_arrays(columns, ["own", "n", "high", "low"])

    parts = state.select("own", "v").mapInArrow(added, "own int, n bigint, high array<bigint>, low array<bigint>")
    cells = parts.select("own", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x"))
    wide = "decimal(38,0)"
    sums = cells.groupBy("own", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("x.high").cast(wide)).alias("high"), F.sum(F.col("x.low").cast(wide)).alias("low")
    )
    out = centroids.copy()
    for r in sums.collect():
        out[r.own, r.i] = ((int(r.high) << 31) + int(r.low)) // r.n
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
    size: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS,
) -> DataFrame:
    """``<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part.

    A vector takes part if it has ``size`` components, none null or not finite. Centroids start
    as the vectors with the ``k`` least hashes of their ids; with fewer vectors there are fewer
    centroids. Each round assigns the vectors and moves the centroids to their floored means;
    the vectors are assigned once more after the last. Repeated rows count each; rows without
    an id are assigned but start no centroid (if no row has an id, the result is empty). An
    empty table gives an empty result. Squared distances and their sums that don't fit a long
    are given as the largest one. Extra columns are left out.

    Broadcast is what ``k * size`` bounds. A round's table replaces the one before it.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    state = settle(integers(vectors, id_col, vec_col, size), "vectors")
    centroids, before = first_centroids(state, k), None
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for turn in range(rounds + 1):
        after = settle(_assigned(state, Step(centroids, before), kind), "assigned")
        drop(state)
        state = after
        if turn < rounds:
            before, centroids = centroids, _moved(state, centroids)
    final = centroids

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("centroids", lambda: None)
        for b in batches:
            own, v = b.column(1).to_numpy(), _matrix(b.column(2)).astype(np.int64)
            far = np.empty(len(own), object)
            for j in np.unique(own):
                far[own == j] = [min(int(d), MOST) for d in squares(v[own == j], final[j])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far.astype(np.int64))], ["id", "cluster", "distance"])

    rows = settle(state.select("id", "own", "v").mapInArrow(measured, f"id {kind}, cluster int, distance bigint"), "clustered")
    drop(state)
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(sums.values()), MOST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    about = [(j, min(d, MOST), total, digests[j]) for j, d in sorted(sums.items())]
    table = vectors.sparkSession.createDataFrame(about, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = rows.join(F.broadcast(table), F.col("cluster") == F.col("number"))  # one row a centroid
    return joined.withColumnRenamed("id", id_col).select(*names)


def _oracle(k: int = CENTROIDS, size: int = COMPONENTS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, round by round, for tables whose ids are not repeated."""
    steps = [
        f"""x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v FROM (
  SELECT v, sha256('2:' || vec_id) AS h FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, j := j)) AS best FROM (
  SELECT vec_id, j, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{t} c) GROUP BY vec_id)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT j, i, sum(e) AS s, count(*) AS n FROM (
  SELECT best.j AS j, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x JOIN a{t} USING (vec_id)) GROUP BY j, i),
n{t} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{t} GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT j, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN n{t} n USING (j))""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, best.j AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.j = best.j"""


ORACLE = _oracle()
