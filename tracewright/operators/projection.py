"""Projection, filters, predicates, subqueries and common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables


@query("proj_expressions", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_quantity > 25 AS large FROM lineitem")
def proj_expressions(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), (F.col("l_quantity") > 25).alias("large"))


@query("proj_rename_drop", "SELECT p_partkey AS part, p_brand AS brand, p_size * 2 AS double_size FROM part")
def proj_rename_drop(t: Tables) -> DataFrame:
    return t.part.withColumnRenamed("p_partkey", "part").withColumn("double_size", F.col("p_size") * 2).withColumnRenamed("p_brand", "brand").drop("p_name", "p_type", "p_size", "p_retailprice")


@query("filter_three_valued", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1) OR l.toxic IS NULL")
def filter_three_valued(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(~(F.col("quality") == 1) | F.col("toxic").isNull()).select("doc_id")


@query("filter_predicates", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%U%' AND NOT regexp_matches(o_orderpriority, '^3') AND o_orderdate IS NOT NULL")
def filter_predicates(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.where(c("o_totalprice").between(1000, 200000) & c("o_orderstatus").isin("O", "F") & c("o_orderpriority").like("%U%") & ~c("o_orderpriority").rlike("^3") & c("o_orderdate").isNotNull()).select("o_orderkey")


@query("filter_null_safe_equal", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT DISTINCT FROM CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 1 END")
def filter_null_safe_equal(t: Tables) -> DataFrame:
    other = F.when(F.col("doc_id") % 3 != 0, F.lit(1))
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(F.col("quality").eqNullSafe(other)).agg(F.count("*").alias("n"))


@query("proj_bitwise", "SELECT o_orderkey, o_custkey & 255 AS b_and, o_custkey | 7 AS b_or, xor(o_custkey, 85) AS b_xor, ~o_custkey AS b_not FROM orders")
def proj_bitwise(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(F.lit(255)).alias("b_and"), k.bitwiseOR(F.lit(7)).alias("b_or"), k.bitwiseXOR(F.lit(85)).alias("b_xor"), F.bitwise_not(k).alias("b_not"))


@query("subquery_scalar", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def subquery_scalar(t: Tables) -> DataFrame:
    mean = t.part.agg(F.avg("p_retailprice").alias("mean"))  # one row
    return t.part.join(F.broadcast(mean), F.col("p_retailprice") > F.col("mean")).select("p_partkey", "p_retailprice")


@query("subquery_scalar_correlated", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)")
def subquery_scalar_correlated(t: Tables) -> DataFrame:
    mean = t.lineitem.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("half"))
    return t.lineitem.join(mean, "l_partkey").where("l_quantity < half").select("l_orderkey", "l_partkey", "l_quantity")


@query("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def subquery_in(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey")


@query("subquery_not_in_null_aware", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE c_nationkey END FROM customer)")
def subquery_not_in_null_aware(t: Tables) -> DataFrame:
    return t.sql("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE c_nationkey END FROM customer)")


@query("subquery_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
def subquery_exists(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem.where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


both("subquery_predicate_or_exists", "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
both("subquery_lateral_max", "SELECT r_name, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS last_nation FROM region")
both("cte_chain", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
both("cte_shadowing", "WITH nation AS (SELECT r_regionkey AS k, r_name AS v FROM region) SELECT k, v FROM nation")
both("ordinals_group_order", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
both("having_aggregate", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1000 AND count(*) > 10")
both("having_group_column", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING c_mktsegment <> 'BUILDING'")
both("select_without_from", "SELECT 1 AS one, 'a' AS letter, 2 + 3 AS five, CAST(NULL AS INT) IS NULL AS nothing, (SELECT count(*) FROM orders) AS n, (SELECT max(o_totalprice) FROM orders) AS top")
both("inline_table", "SELECT k, v, count(*) AS n FROM (VALUES ('F', 1), ('O', 2), ('P', NULL)) AS x(k, v) JOIN orders ON o_orderstatus = k WHERE v IS NULL OR v > 1 GROUP BY k, v")
both("null_propagation", "SELECT count(CASE WHEN l_quantity < 0 THEN 1 END) AS none, count(*) AS n, CAST(sum(CASE WHEN l_quantity < 0 THEN 1 END) AS BIGINT) AS empty_sum FROM lineitem")


@query("sample_bernoulli")
def sample_bernoulli(t: Tables) -> DataFrame:
    return t.lineitem.sample(False, 0.1, seed=7).agg(F.count("*").alias("n"))


@query("sample_poisson")
def sample_poisson(t: Tables) -> DataFrame:
    return t.lineitem.sample(True, 0.5, seed=7).agg(F.count("*").alias("n"))


@query("sample_tablesample_rows", "SELECT 25 AS n")
def sample_tablesample_rows(t: Tables) -> DataFrame:
    return t.sql("SELECT CAST(count(*) AS INT) AS n FROM (SELECT * FROM orders TABLESAMPLE (25 ROWS))")


@query("sample_tablesample_percent")
def sample_tablesample_percent(t: Tables) -> DataFrame:
    return t.sql("SELECT count(*) AS n FROM orders TABLESAMPLE (10 PERCENT)")


@query("sample_stratified")
def sample_stratified(t: Tables) -> DataFrame:
    return t.lineitem.sampleBy("l_returnflag", {"A": 0.1, "N": 0.5, "R": 1.0}, seed=3).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("sample_random_split", "SELECT count(*) AS n FROM orders")
def sample_random_split(t: Tables) -> DataFrame:
    a, b, c = t.orders.randomSplit([0.5, 0.3, 0.2], seed=11)  # the parts make up the whole
    return a.unionByName(b).unionByName(c).agg(F.count("*").alias("n"))


@query("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 45")
def scan_pruned(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_quantity > 45").select("l_orderkey", "l_quantity")


@query("sql_on_files", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sql_on_files(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{t.path('nation')}` GROUP BY n_regionkey")


@query("range_function", "SELECT id FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) FROM lineitem) + 1, 7)) AS id) WHERE id NOT IN (SELECT l_orderkey FROM lineitem)")
def range_function(t: Tables) -> DataFrame:
    """Every seventh number up to the largest key that no line has."""
    top = t.lineitem.agg(F.max("l_orderkey")).first()[0]
    return t.spark.range(0, (-1 if top is None else top) + 1, 7).join(t.lineitem.select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("range_table_function", "SELECT r.range AS quantity, count(l_orderkey) AS n FROM range(5, 60) r LEFT JOIN lineitem ON l_quantity = r.range GROUP BY 1")
def range_table_function(t: Tables) -> DataFrame:
    """Each quantity of a range with its lines, also those without any."""
    return t.sql("SELECT r.id AS quantity, count(l_orderkey) AS n FROM range(5, 60, 1, 4) r LEFT JOIN lineitem ON CAST(l_quantity AS BIGINT) = r.id AND l_quantity = r.id GROUP BY 1")


@query("partition_id_prune", "SELECT count(*) AS n FROM orders")
def partition_id_prune(t: Tables) -> DataFrame:
    p = t.orders.repartition(4, "o_orderkey").withColumn("p", F.spark_partition_id())
    return p.where("p < 2").unionByName(p.where("p >= 2")).agg(F.count("*").alias("n"))
