"""Feeds, rates, models learned batch by batch, running moments and measured jobs."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.plans.measures import MeasuredJobs, RunningMoments, running_stragglers
from tracewright.sources.tables import Tables
from tracewright.streaming.feed import EVENTS, RateController, controlled, fed_events, feed, read_small, run_once, write_small
from tracewright.streaming.online import OnlineClusters, OnlineLinear, Versions, learning


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_rate_follows_its_closed_form():
    c = RateController(interval=2.0, proportional=0.5, integral=0.25, derivative=0.1, least=10)
    assert c.update(1.0, 0, 1.0, 0.0) is None  # nothing was done
    assert c.update(2.0, 400, 2.0, 0.0) == 200
    gap = 200 - 300 / 3
    rate = 200 - 0.5 * gap - 0.25 * (1.5 * 100 / 2.0) - 0.1 * (gap - 0) / 4
    assert math.isclose(c.update(6.0, 300, 3.0, 1.5), rate)
    assert c.update(5.0, 300, 3.0, 1.5) == c.rate  # out of order
    assert c.update(7.0, 1, 100.0, 500.0) >= 10
    c = RateController(interval=1.0, least=1)
    for i in range(30):
        c.update(i + 1.0, 500, 1.0, 0.0)
    assert math.isclose(c.rate, 500)


def test_a_slow_sink_is_fed_less(tables, tmp_path):
    path, state, rate = fed_events(tables, 2), str(tmp_path / "state"), str(tmp_path / "rate.json")
    sizes, controller = [], RateController(interval=0.05, least=20)

    def slow(d, i):
        n = d.count()
        sizes.append(n)
        time.sleep(n / 1000)

    for _ in range(4):
        run_once(tables, feed(tables, path, EVENTS, state, rows=600, rate=rate, interval=0.05), controlled(slow, controller, rate), state)
    assert sizes[0] == 600 and max(sizes[1:]) <= 60 and read_small(rate)["rate"] == controller.rate


def test_a_batch_that_failed_is_read_again(tables, tmp_path):
    path, state = fed_events(tables, 3), str(tmp_path / "state")
    seen, fail = {}, [1]

    def keep(d, i):
        seen[i] = sorted(r.event_id for r in d.select("event_id").collect())
        if i in fail:
            fail.remove(i)
            raise ValueError("lost")

    for _ in range(12):
        try:
            if not run_once(tables, feed(tables, path, EVENTS, state, rows=300, part=70), keep, state):
                break
        except Exception:  # noqa: BLE001
            first = seen[1]
    assert not fail and set(first) <= set(seen[1])
    ids = [x for i in sorted(seen) for x in seen[i]]
    assert sorted(ids) == sorted(r.event_id for r in tables.events.select("event_id").collect())


def test_small_files_are_replaced(tmp_path):
    path = str(tmp_path / "x.json")
    assert read_small(path) is None
    for i in range(2):
        write_small(path, {"i": i})
        assert read_small(path) == {"i": i}


def test_weights_are_those_of_numpy_and_survive_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 2))
    y = (x @ [2.0, -1.0] + 0.5 + rng.standard_normal(300) > 0).astype(int)
    batches = [spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x[i::3], y[i::3], strict=True)] + [(None, 1.0, 1)], "a double, b double, y int") for i in range(3)]
    model = OnlineLinear(["a", "b"], "y", step=1.5, shrink=0.05)
    versions = Versions(spark, str(tmp_path / "model"))
    assert versions.before() is None
    for i, d in enumerate(batches):
        learning(model, versions)(d, i)
    w = np.zeros(3)
    for t in range(3):
        z = np.column_stack([x[t::3], np.ones(100)])
        g = ((1 / (1 + np.exp(-z @ w)) - y[t::3])[:, None] * z).mean(0) + 0.05 * np.array([w[0], w[1], 0])
        w = w - 1.5 / np.sqrt(t + 1) * g
    assert np.allclose(versions.before()["w"], w, atol=1e-12)
    end = versions.before()
    for i in (1, 2):  # the last batches are run again, as after a failure
        learning(model, Versions(spark, str(tmp_path / "model")))(batches[i], i)
    assert versions.before() == end
    assert model.next(end, batches[0].where("false")) == end


def test_clusters_forget_by_their_half_life(spark):
    model = OnlineClusters(["x"], [[0.0], [10.0], [99.0]], half_life=1.0)
    one = model.next(model.start(), spark.createDataFrame([(1.0,), (2.0,), (9.0,), (5.0,), (None,)], "x double"))
    assert one == {"centres": [[8 / 3], [9.0], [99.0]], "weights": [3.0, 1.0, 0.0]}  # 5 is as far from both
    two = model.next(one, spark.createDataFrame([(4.0,)], "x double"))
    assert two["weights"] == [2.5, 0.5, 0.0] and math.isclose(two["centres"][0][0], (8 / 3 * 1.5 + 4) / 2.5)


def test_moments_merge(spark):
    x = np.random.default_rng(1).lognormal(size=500).tolist()
    parts = [RunningMoments(), RunningMoments()]
    for i, v in enumerate(x):
        parts[i % 3 == 0].add(v)
    both = parts[0].merge(parts[1]).merge(RunningMoments())
    assert both.n == 500 and math.isclose(both.mean, np.mean(x)) and math.isclose(both.deviation, np.std(x))


def test_stragglers_by_hand(spark):
    rows = [("a", i, x) for i, x in enumerate([5.0, 5.0, 5.1, 50.0, 50.0, None, 500.0])] + [("b", i, x) for i, x in enumerate([0.1, 0.1, 0.9, 1.5])] + [(None, 0, 9.0), (None, 1, 10.0)]
    got = running_stragglers(spark.createDataFrame(rows, "w string, i int, ms double").repartition(3), "w", ["i"], "ms").collect()
    assert {(r.w, r.i) for r in got} == {("a", 2), ("a", 3), ("a", 6), ("b", 3), (None, 1)}


def test_measured_jobs_are_those_of_the_block(tables):
    tables.nation.count()
    with MeasuredJobs(tables.spark) as jobs:
        tables.customer.select("c_custkey", "c_name").write.format("noop").mode("overwrite").save()
    tables.orders.select("o_orderkey").write.format("noop").mode("overwrite").save()
    assert jobs.tasks().agg(F.sum("records_read")).first()[0] == tables.customer.count()
    with MeasuredJobs(tables.spark) as none:
        pass
    assert none.tasks().collect() == []
