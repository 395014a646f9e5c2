"""Sorting, limits, top-k and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables

both("sort_null_ordering", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id DESC LIMIT 50")
both("limit_on_types", "SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 7")
both("limit_offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")
both("sort_by_expression", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_partkey LIMIT 40")


@query("sort_global", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_global(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("sort_is_total_order", "SELECT 0 AS violations")
def sort_is_total_order(t: Tables) -> DataFrame:
    """Row numbers over the sorted key never disagree with the key itself."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    rows = t.orders.withColumn("d", F.col("o_totalprice") - F.lag("o_totalprice").over(w))
    return rows.agg(F.count(F.when(F.col("d") < 0, 1)).cast("int").alias("violations"))


@query("topk_project", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def topk_project(t: Tables) -> DataFrame:
    return t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 2")
def topk_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("r", F.row_number().over(w)).where("r <= 2").select("c_nationkey", "c_custkey")


@query("sort_within_partitions", "SELECT count(*) AS n, 0 AS violations FROM orders")
def sort_within_partitions(t: Tables) -> DataFrame:
    """Secondary sort: rows of a key are together and ordered, as one pass over each partition shows."""
    rows = t.orders.repartition(8, "o_custkey").sortWithinPartitions("o_custkey", "o_orderdate").withColumn("p", F.monotonically_increasing_id())
    w = Window.partitionBy("o_custkey").orderBy("p")
    late = (F.lag("o_orderdate").over(w) > F.col("o_orderdate")).cast("int")
    return rows.withColumn("late", late).agg(F.count("*").alias("n"), F.coalesce(F.sum("late"), F.lit(0)).cast("int").alias("violations"))


@query("distribute_and_cluster_by", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def distribute_and_cluster_by(t: Tables) -> DataFrame:
    return t.sql("SELECT p_brand, count(*) AS n FROM (SELECT * FROM part DISTRIBUTE BY p_brand SORT BY p_size) GROUP BY p_brand CLUSTER BY p_brand")


@query("repartition_round_trip", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def repartition_round_trip(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").repartition(7).coalesce(3).repartitionByRange(4, "o_orderkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("filter_by_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
def filter_by_range(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey").between(100, 400)).select("o_orderkey")


@query("take_ordered", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def take_ordered(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_acctbal", "c_custkey").limit(10).select("c_custkey")


@query("take_sample", "SELECT 20 AS n")
def take_sample(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.rand(3)).limit(20).agg(F.count("*").cast("int").alias("n"))
