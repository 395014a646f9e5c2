"""Filters that reach a Python source, samples by bucket, and broadcasts of a measured size."""

import pytest
from pyspark.sql import functions as F

from tracewright.sources.pushdown import PARTS, bucket_sample, bucketed_orders, measured_join, row_groups, sorted_parts
from tracewright.sources.tables import Tables


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


FILTERS = ["p_size = 7", "p_size > 40 AND p_size <= 44", "p_size IN (1, 50)", "p_size < 0", "p_name IS NULL", "p_retailprice >= 1000 AND p_size <> 5", "p_size IS NOT NULL", "p_name LIKE '%a%' OR p_size = 2", "p_size = 3 AND p_size = 4"]


def test_filters_reach_the_source(tables):
    path = sorted_parts(tables)
    rows = row_groups(tables.spark, path, PARTS)
    plain = tables.spark.read.parquet(path)
    for f in FILTERS:
        assert sorted(map(str, rows.where(f).collect())) == sorted(map(str, plain.select(*rows.columns).where(f).collect())), f
    assert rows.rdd.getNumPartitions() == 4 and rows.where("p_size = 7").rdd.getNumPartitions() < 3


def test_buckets_are_pruned_and_make_up_the_table(tables):
    name, spark = bucketed_orders(tables, 8), tables.spark
    whole = sorted(r.o_orderkey for r in tables.orders.collect())
    files = spark.table(name).inputFiles()
    for out_of, column in ((4, None), (8, "o_orderkey"), (3, "o_orderkey"), (5, "o_custkey")):
        parts = [bucket_sample(spark, name, i + 1, out_of, column) for i in range(out_of)]
        assert sorted(r.o_orderkey for p in parts for r in p.collect()) == whole, out_of
        if 8 % out_of == 0:
            read = [p.inputFiles() for p in parts]
            assert all(len(r) <= len(files) // out_of for r in read) and sum(map(len, read)) == len(files)
            wrong = [p.where(F.pmod(F.hash("o_orderkey"), F.lit(out_of)) != i).count() for i, p in enumerate(parts)]
            assert not any(wrong)
    with pytest.raises(ValueError):
        bucket_sample(spark, name, 0, 4)


def test_a_side_is_broadcast_within_its_limit_only(tables):
    right = tables.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    frames = [measured_join(tables.orders, right, ["o_custkey"]), measured_join(tables.orders, right, ["o_custkey"], most_rows=10), measured_join(tables.orders, right, ["o_custkey"], most_bytes=100)]
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False, False] and "SortMergeJoin" in plans[1]
    assert len({f.count() for f in frames}) == 1
