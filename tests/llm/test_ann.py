"""Multi-index hashing: radius search against a scan, recall against brute force, odd vectors."""

import math

import numpy as np
import pytest

from lodestar.llm import ann


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (40, 4), dtype=np.uint16)
    codes = np.concatenate([base ^ (1 << rng.integers(0, 16, (40, 4))).astype(np.uint16) for _ in range(20)])
    index = ann.Index(codes)
    for radius in (0, 1, 3, 5, 8, 13, 64):
        for code in base[:10]:
            got = set(index.within(code, radius).tolist())
            assert got == set(np.flatnonzero(ann.distances(codes, code) <= radius).tolist())


def test_probing_by_enumeration_equals_probing_by_values(monkeypatch):
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 1 << 16, (3000, 3), dtype=np.uint16)
    index = ann.Index(codes)
    for bits in (-1, 0, 1, 2, 3, 5, 16, 20):
        for code in codes[:5]:
            got = np.sort(index.probed(1, int(code[1]), bits))
            assert (got == np.flatnonzero(np.bitwise_count(codes[:, 1] ^ code[1]).astype(int) <= bits)).all()
    assert len(ann.flips(2)) == 137 and len(index.tables[1][1]) > 137  # few bits are enumerated


def test_recall_on_the_table(spark):
    """All queries whose id is divisible by 20, against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    data, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    found = ann.neighbours(table, every=20).toPandas().groupby("query_id").vec_id.apply(set).to_dict()
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        away = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, away)) if ids[j] != ids[i]][:10]
        hits.append(len(found[ids[i]] & set(ids[order])) / 10)
    assert len(hits) == len(found) and np.mean(hits) >= 0.9


def brute(vectors, every, k):
    out = {}
    for q in vectors:
        if q % every == 0:
            away = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)[:k]
            out[q] = [i for _, i in away]
    return out


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_and_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD_VALUES", 700 * 24)
    monkeypatch.setattr(ann, "BLOCK_VALUES", 40 * 24)
    rng = np.random.default_rng(5)
    data = rng.standard_normal((3000, 24))
    if kind == "clustered":
        data = rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)] * 3 + data * 0.3
    vectors = {i: v.astype(np.float32).astype(float).tolist() for i, v in enumerate(data)}
    frame = spark.createDataFrame([(i, v, 0.0, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, score double, rank int")
    found = {}
    for r in sorted(ann.neighbours(frame, every=30).collect(), key=lambda r: (r.query_id, r.rank)):
        assert abs(math.dist(vectors[r.query_id], vectors[r.vec_id]) - r.score) < 1e-9
        found.setdefault(r.query_id, []).append(r.vec_id)
    true = brute(vectors, 30, 10)
    assert set(found) == set(true) and all(len(x) == 10 for x in found.values())
    assert np.mean([len(set(found[q]) & set(true[q])) / 10 for q in true]) >= 0.95


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.5, 0.0]), (4, [9.0, 9.0])]
    rows += [(200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, []), (800, [1.0])]
    rows += [(None, [1.0, 1.0]), (0, [1.0, 0.0])]
    out = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in out.collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 100), (100, 1, 4), (100, 2, 0), (100, 3, 2), (100, 4, 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.neighbours(empty).collect() == []
