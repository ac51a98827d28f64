"""Hamerly's bounds against full scans in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tabscope.llm import clusters, queries
from tabscope.llm.clusters import Clustering


def brute(rows, how):
    """(key, cluster, distance) and the centroids, every vector against every centroid in every round."""
    kept = [(k, [math.floor(how.scale * float(c)) for c in v]) for k, v in rows
            if v is not None and len(v) == how.components and all(c is not None and math.isfinite(c) for c in v)]
    seeds = [(k, x) for k, x in kept if k is not None]
    named = sorted(seeds, key=lambda r: (hashlib.sha256(f"{how.seed}:{r[0]}".encode()).hexdigest(), r[1])) or sorted(kept, key=lambda r: r[1])
    centroids = [x for _, x in named[: how.clusters]]

    def assigned():
        out = []
        for _, x in kept:
            far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(how.rounds):
        own = assigned()
        for j in range(len(centroids)):
            part = [x for (_, x), (c, _) in zip(kept, own, strict=True) if c == j]
            if part:
                centroids[j] = [sum(col) // len(part) for col in zip(*part, strict=True)]
    return sorted(((k, *c) for (k, _), c in zip(kept, assigned(), strict=True)), key=str), centroids


def held(frame):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in frame.collect()), key=str)


def vectors(seed, n, d, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(5)]
    return [(k, [c + rng.gauss(0, 0.3) for c in centres[k % 5]]) for k in range(n)]


@pytest.mark.parametrize(("seed", "k", "d", "rounds", "scale"), [(1, 8, 6, 10, 1024), (2, 3, 2, 4, 3), (3, 5, 4, 12, 1), (4, 1, 3, 2, 10)])
def test_against_full_scans(spark, monkeypatch, seed, k, d, rounds, scale):
    monkeypatch.setattr(clusters, "BLOCK", 37)
    how = Clustering(k, d, rounds, scale)
    rows = vectors(seed, 150, d) + [(900, None), (901, [1.0] * (d + 1)), (902, [None] + [0.0] * (d - 1)), (903, [math.nan] * d), (904, [math.inf] * d)]
    rows += [(7, rows[7][1]), (7, [0.5] * d), (None, [0.25] * d)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, centroids = clusters.clustered(data, how)
    truth, final = brute(rows, how)
    assert held(found) == truth
    assert centroids.tolist() == final


def test_ties_and_equal_vectors(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(20)] + [(50, [0.5, 0.0])]
    how = Clustering(4, 2, 3, 10)
    found, centroids = clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), how)
    assert held(found) == brute(rows, how)[0]


def test_large_components(spark):
    rows = [(k, [1e30 * (k % 3), 2.0**70, 5e8 * k]) for k in range(9)]
    how = Clustering(2, 3, 3, 1024)
    found, centroids = clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), how)
    truth, final = brute(rows, how)
    assert held(found) == [(k, c, d if d < 1 << 63 else None) for k, c, d in truth]
    assert centroids.tolist() == final
    about = clusters.with_inertia(found, centroids).collect()
    assert all(r["inertia"] is None for r in about)


def test_bounds_spare_scans():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-5, 5, (500, 4)), rng.integers(995, 1005, (500, 4))])
    before, after = np.array([[0] * 4, [1000] * 4], object), np.array([[1] * 4, [1001] * 4], object)
    own, upper, lower = clusters.scanned(x, before)
    again, up, low, scans = clusters.reassigned(x, own, upper.copy(), lower.copy(), before, after)
    assert scans == 0 and (again == own).all()
    true = np.sqrt(clusters.squared(x, after).astype(float))
    assert (up >= true[np.arange(1000), own]).all() and (low <= true[np.arange(1000), 1 - own]).all()


def test_query(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    truth, final = brute(rows, Clustering())
    found = queries.op12_centroids(spark, tables)
    assert held(found) == truth
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    for r in found.collect():
        assert r["inertia"] == sum(d for *_, d in truth)
        assert r["cluster_inertia"] == sum(d for _, c, d in truth if c == r["cluster"])
        assert r["centroid_sha256"] == digest[r["cluster"]]


def test_no_vectors(spark):
    found, centroids = clusters.clustered(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert clusters.with_inertia(found, centroids).collect() == []
    only = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert held(clusters.clustered(only, Clustering(2, 2, 2))[0]) == [(None, 0, 0)]
