"""Bloom filters: no key is lost, few others pass, at one shard and at several."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators.aggregates import bloom_size, bloom_thinned


@pytest.mark.parametrize("shard_bits", [1 << 20, 1 << 12])
def test_no_key_is_lost(spark, shard_bits):
    keys = spark.range(0, 30000, 3).select(F.col("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    rows = spark.range(60000).selectExpr("id AS k", "id % 3 = 0 AND id < 30000 AS member").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, false AS member"))
    found = bloom_thinned(rows, "k", keys, 0.03, shard_bits)
    members, others = found.agg(F.count_if("member"), F.count_if(~F.col("member"))).first()
    assert members == 10000 and others < 0.05 * 50000 and found.columns == ["k", "member"]


def test_sizes(spark):
    assert bloom_size(10**9, 0.03)[0] > 7 * 10**9 and bloom_size(0) == (64, 5)
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert bloom_thinned(rows, "k", rows, broadcast_bytes=1) is rows
    assert bloom_thinned(rows, "k", rows.limit(0)).count() == 0
