"""Generated graphs against their closed forms and stated distributions."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graph_generators as G


def test_grid_and_star(spark):
    cells = spark.range(16)
    edges = {tuple(r) for r in G.grid(cells, "id", 4).collect()}
    want = {(i, i + 1) for i in range(16) if i % 4 < 3} | {(i, i + 4) for i in range(12)}
    assert edges == want and len(want) == 24
    assert {tuple(r) for r in G.star(spark.range(10), "id").collect()} == {(i, 0) for i in range(1, 10)}


def test_uniform_numbers_are_spread(spark):
    u = spark.range(40000).selectExpr(f"{G.uniform('id', 3)} AS u", f"{G.uniform('id', 4)} AS v")
    row = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u"), F.corr("u", "v")).first()
    assert 0 < row[0] < 0.01 and 0.99 < row[1] < 1
    assert row[2] == pytest.approx(0.5, abs=0.01) and row[3] == pytest.approx(math.sqrt(1 / 12), abs=0.01) and abs(row[4]) < 0.03


def test_log_normal_degrees(spark):
    logs = spark.range(40000).selectExpr(f"{G.normal('id', 1)} AS z")
    mean, deviation = logs.agg(F.avg("z"), F.stddev("z")).first()
    assert mean == pytest.approx(0, abs=0.03) and deviation == pytest.approx(1, abs=0.03)
    edges = G.log_normal(spark.range(2000), "id", 2000, 1.0, 0.7)
    assert edges.where("dst < 0 OR dst >= 2000").count() == 0
    again = G.log_normal(spark.range(2000).repartition(7), "id", 2000, 1.0, 0.7)
    assert edges.exceptAll(again).count() == 0 == again.exceptAll(edges).count()


def test_recursive_matrix_fills_its_quadrants(spark):
    edges = G.recursive_matrix(spark.range(40000), "id", 5)
    shares = {(r.s, r.d): r["count"] / 40000 for r in edges.selectExpr("src >= 16 AS s", "dst >= 16 AS d").groupBy("s", "d").count().collect()}
    assert shares[False, False] == pytest.approx(0.45, abs=0.02)
    assert shares[False, True] == pytest.approx(0.15, abs=0.02)
    assert shares[True, False] == pytest.approx(0.15, abs=0.02)
    assert shares[True, True] == pytest.approx(0.25, abs=0.02)


def test_no_vertices(spark):
    none = spark.range(0)
    assert G.grid(none, "id", 1).count() == G.star(none, "id").count() == G.log_normal(none, "id", 1, 1.0, 1.0).count() == G.recursive_matrix(none, "id", 3).count() == 0
