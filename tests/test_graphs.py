"""Graph loops on graphs of a long diameter, where a bound on the rounds would show."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators.graph_tools import promises_kept, rank_to_tolerance
from tracewright.operators.graphs import NotConverged, connected_components, pregel, shortest_paths, strong_components


def graph(spark, edges, vertices):
    return spark.createDataFrame([(v,) for v in vertices], "id long"), spark.createDataFrame(edges, "src long, dst long")


def chain(n, seed):
    """A path through the numbers below n in a random order."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return list(zip(order, order[1:], strict=False))


def states(df):
    return {r.id: r[1] for r in df.collect()}


def test_components_of_a_chain_and_a_grid(spark):
    side = 12
    grid = [(1000 + r * side + c, 1000 + (r + dr) * side + c + dc) for r in range(side) for c in range(side) for dr, dc in ((0, 1), (1, 0)) if r + dr < side and c + dc < side]
    loose = [(5000, 5000), (6001, 6000), (6001, 6002)]
    v, e = graph(spark, chain(300, 1) + grid + loose, [*range(300), *range(1000, 1000 + side * side), 5000, 6000, 6001, 6002, 7000])
    got = states(connected_components(v, e, most=14))  # rounds grow with the logarithm of the diameter
    want = {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1000 + side * side), 1000), 5000: 5000, 6000: 6000, 6001: 6000, 6002: 6000, 7000: 7000}
    assert got == want


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    v, e = graph(spark, edges, range(200))
    assert states(connected_components(v, e)) == dict(enumerate(root))


def test_a_stated_bound_raises(spark):
    v, e = graph(spark, chain(40, 2), range(40))
    with pytest.raises(NotConverged):
        connected_components(v, e, most=1)
    start = v.select("id", F.col("id").alias("state"))
    with pytest.raises(NotConverged):
        pregel(start, e, lambda x: x.select(F.col("dst").alias("id"), F.col("state").alias("message")), F.min("message"), F.least("state", "message"), most=3)
    with pytest.raises(NotConverged):
        rank_to_tolerance(v, e, tolerance=1e-12, most=2)


def test_shortest_paths_beyond_fifty_hops(spark):
    edges = [(i + 1, i) for i in range(59)]
    v, e = graph(spark, [*edges, (100, 101)], [*range(60), 100, 101])
    got = states(shortest_paths(v, e, F.col("id") == 0))
    assert got == {**{i: i for i in range(60)}, 100: None, 101: None}


def test_strong_components_of_a_ring_and_its_tail(spark):
    ring = [(i, (i + 1) % 20) for i in range(20)]
    v, e = graph(spark, [*ring, (3, 30), (30, 31), (31, 30), (31, 40)], [*range(20), 30, 31, 40])
    assert states(strong_components(v, e)) == {**dict.fromkeys(range(20), 0), 30: 30, 31: 30, 40: 40}


def test_promises_of_no_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert promises_kept(edges).first().asDict() == {"edges": 0, "source_in_one": True, "pairs_together": 0, "grid_bound": True}
    some = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    assert promises_kept(some).first().asDict() == {"edges": 3, "source_in_one": True, "pairs_together": 1, "grid_bound": True}
