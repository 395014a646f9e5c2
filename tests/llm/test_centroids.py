"""Centroid clustering against plain integers, and its error intervals."""

import hashlib
import math

import numpy as np
import pytest
from comparing import duck, rows_of

from tracewright.llm import queries
from tracewright.llm.centroids import SAFE, cluster_vectors, nearest, screen


def naive(rows, k, rounds, width):
    """(id, cluster, distance, cluster inertia, inertia, digest) by the definition, in Python's integers."""
    kept = [(i, [math.floor(x * 64) if abs(x) < 2**53 else int(x) * 64 for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [r[1] for r in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for n in range(len(centroids)):
            own = [v for (_, v, _), (_, m) in zip(kept, found, strict=True) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assigned()
    sums = [sum(d for d, m in found if m == n) for n in range(len(centroids))]
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, m, long(d), long(sums[m]), long(sum(sums)), digest[m]) for (i, _, _), (d, m) in zip(kept, found, strict=True)), key=str)


def run(spark, rows, k, rounds, width, kind="double"):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string").repartition(3)
    return sorted(map(tuple, cluster_vectors(df, k, rounds, width).collect()), key=str)


def test_sql_and_clusters_agree(spark, sf_dir):
    df = queries.queries()["op11_centroids"](spark, sf_dir)
    want = duck(sf_dir).execute(queries.oracle_sql()["op11_centroids"])
    columns = [d[0] for d in want.description]
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("scale", [1, 5000, 1e6, 1e12, 1e30])
def test_clusters_of_any_size_of_number(spark, scale):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.standard_normal(5) * scale).tolist()) for i in range(150)]
    rows += [(200 + i, [0.0, 1.0, 0.5, -0.25, -1 / 64]) for i in range(30)]  # among small ones whatever the scale
    assert run(spark, rows, 7, 3, 5) == naive(rows, 7, 3, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [1.0, -inf]), (7, [1.0, 2.0, 3.0]), (8, []), (1, [9.0, 9.0]), (1, [1.0, 2.0]), (None, [1.0, 2.5])]
    got = run(spark, rows, 16, 3, 2)
    assert got == naive(rows, 16, 3, 2) and len(got) == 4  # as many centroids as vectors with an id
    assert run(spark, [], 16, 3, 2) == [] and run(spark, [(None, [1.0, 2.0])], 16, 3, 2) == []


def test_empty_clusters_stay_and_ties_go_to_the_smaller_number(spark):
    rows = [(i, [0.0, 0.0]) for i in range(20)] + [(20, [4.0, 0.0]), (21, [2.0, 0.0])]
    got = run(spark, rows, 5, 2, 2)
    assert got == naive(rows, 5, 2, 2)


@pytest.mark.parametrize("most", [3, 1000, 2**14, SAFE])
def test_intervals_hold_the_exact_value(most):
    rng = np.random.default_rng(most)
    x, c = rng.integers(-most, most + 1, (300, 64)), rng.integers(-most, most + 1, (16, 64))
    low, high = screen(x, c)
    exact = (c * c).sum(1) - 2 * (x @ c.T)
    assert (low <= exact).all() and (exact <= high).all()
    if most <= 3:
        assert (low == high).all()  # float32 is exact there
    number, distance = nearest(x, c)
    far = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_overlapping_intervals_are_decided_exactly():
    """Centroids of length 2^23 that differ by one unit: the product cannot tell them apart, the integers can."""
    base = np.full(64, SAFE - 5)
    c = np.array([base + (np.arange(64) == j) for j in range(8)])
    x = np.array([base + 2 * (np.arange(64) == j) for j in (6, 3, 0)])
    low, high = screen(x, c)
    assert ((low <= high.min(1, keepdims=True)).sum(1) > 1).all()
    assert nearest(x, c)[0].tolist() == [6, 3, 0]
