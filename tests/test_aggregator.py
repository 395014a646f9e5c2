"""User-defined aggregates: hot keys, nulls, no keys, small limits, and the plan."""

import math

import numpy as np
import pytest

from tracewright.operators.aggregator import Largest, Moments, Quantiles, WeightedMean, aggregate


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 40}", float(i * 7919 % 1009) if i % 13 else None, 1 + i % 4) for i in range(4000)]
    return data, spark.createDataFrame(data, "k string, x double, w int").repartition(7)


def by_key(data):
    out = {}
    for k, x, w in data:
        out.setdefault(k, []).append((x, w))
    return out


@pytest.mark.parametrize(("salts", "most"), [(1, 1), (3, 2), (8, 10_000)])
def test_aggregates_whatever_the_limits(rows, salts, most):
    data, df = rows
    top = {r.k: r.top for r in aggregate(df, ["k"], Largest("x", 3), "top", salts, most).collect()}
    mean = {r.k: r.m for r in aggregate(df, ["k"], WeightedMean("x", "w"), "m", salts, most).collect()}
    moments = {r.k: r.m for r in aggregate(df, ["k"], Moments("x"), "m", salts, most).collect()}
    want = by_key(data)
    assert top.keys() == mean.keys() == moments.keys() == want.keys()
    for k, pairs in want.items():
        known = [(x, w) for x, w in pairs if x is not None]
        xs = [x for x, _ in known]
        assert top[k] == sorted(xs, reverse=True)[:3]
        assert math.isclose(mean[k], sum(x * w for x, w in known) / sum(w for _, w in known))
        assert moments[k].n == len(xs) and math.isclose(moments[k].variance, np.var(xs, ddof=1))


def test_without_keys_and_without_rows(rows):
    data, df = rows
    assert [r.top for r in aggregate(df, [], Largest("x", 2), "top").collect()] == [[1008.0, 1008.0]]
    assert aggregate(df.where("false"), ["k"], Largest("x", 2), "top").collect() == []
    only_null = aggregate(df.where("x is null"), [], Moments("x"), "m").first().m
    assert (only_null.n, only_null.mean, only_null.variance) == (0, None, None)


def test_quantiles_stay_close_and_small():
    rng = np.random.default_rng(5)
    digest = Quantiles("x", [0.01, 0.5, 0.99])
    x = rng.lognormal(size=60_000)
    state = digest.zero()
    for part in np.array_split(x, 60):
        state = digest.merge(state, digest.reduce(digest.zero(), {"x": part}))
    assert len(state) < 6 * digest.size and math.isclose(state[:, 1].sum(), len(x))
    for q, v in zip(digest.at, digest.finish(state), strict=True):
        assert abs((x <= v).mean() - q) < 0.01


def test_states_are_reduced_before_they_are_shuffled(rows):
    plan = aggregate(rows[1], ["k"], Largest("x", 3), "top")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "MapInArrow" in line or "Repartition" in line]
    assert ["MapInArrow" in line for line in lines][:5] == [True, False, True, False, True]
