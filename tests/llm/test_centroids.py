"""Centroid clustering against plain rounds over Python integers."""

import hashlib
import math
import random

import numpy as np

from lodestar.llm import centroids


def plain(rows, size, k, rounds):
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    if not centres:
        return []

    def far(v, c):
        return sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    own = assign()
    rows = [(i, o, far(v, centres[o])) for (i, v), o in zip(kept, own, strict=True)]
    sums = {o: sum(d for _, x, d in rows if x == o) for o in own}
    return [(i, o, d, sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for i, o, d in rows]


def run(spark, rows, size, k, rounds, kind="float"):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, id string")
    return sorted(map(tuple, centroids.cluster(frame.repartition(5), size=size, k=k, rounds=rounds).collect()), key=str)


def test_equals_plain_rounds(spark):
    rng = random.Random(6)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in middles[i % 5]]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(20)] + [(7, rows[7][1]), (7, [9.0] * 6), (None, [0.25] * 6)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [None] * 6), (2005, [1.0, math.nan] * 3), (2006, [math.inf] * 6)]
    for k, rounds in ((12, 5), (40, 2), (500, 1)):
        assert run(spark, rows, 6, k, rounds) == sorted(plain(rows, 6, k, rounds), key=str)


def test_ties_and_empty_centroids(spark):
    # On a grid most vectors are as far from several centroids; repeated start vectors leave centroids empty.
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]
    for k in (3, 8, 30):
        assert run(spark, rows, 2, k, 4) == sorted(plain(rows, 2, k, 4), key=str)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [1e6 + rng.random() * 100, -3e9 + rng.random() * 1e5, rng.random()]) for i in range(60)]
    assert run(spark, rows, 3, 7, 3, "double") == sorted(plain(rows, 3, 7, 3), key=str)
    huge = run(spark, [(1, [1e300] * 2), (2, [-1e300] * 2), (3, [0.0, 0.0])], 2, 1, 0, "double")
    assert len(huge) == 3 and max(r[2] for r in huge) == centroids.MOST


def test_bounds_skip_distances_and_never_change_the_choice():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(2000, 8)) * 60 + rng.integers(0, 6, (2000, 1)) * 900).astype(np.int64)
    c, before = v[:20].copy(), None
    own, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf, np.float32), np.zeros((2000, 20), np.float32)
    computed = []
    for _ in range(6):
        own, upper, lower, n = centroids.Step(c, before).assign(v, own, upper, lower)
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper.astype(np.float64) ** 2 >= d[np.arange(2000), own] * (1 - 1e-12)).all()
        assert (lower.astype(np.float64) ** 2 <= d * (1 + 1e-12)).all()
        computed.append(n)
        before = c
        c = np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(20)])
    assert computed[-1] < 0.2 * 2000 * 20


def test_empty_table(spark):
    assert run(spark, [], 4, 3, 2) == [] and run(spark, [(1, None), (None, [1.0] * 4)], 4, 3, 2) == []
