"""Set operations, de-duplication, null handling and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables

both("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("set_union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
both("set_intersect_null_safe", "SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_regionkey END AS k FROM nation INTERSECT SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region")
both("set_union_coerced", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_acctbal FROM customer")


@query("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
def set_except_all(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("k")).exceptAll(t.region.select("r_regionkey"))


@query("set_union_by_name", "SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def set_union_by_name(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")).unionByName(t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("set_subtract_keep_duplicates", "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def set_subtract_keep_duplicates(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey").join(t.orders.where("o_orderstatus = 'O'"), F.col("l_orderkey").eqNullSafe(F.col("o_orderkey")), "left_anti")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("drop_duplicates_by_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def drop_duplicates_by_key(t: Tables) -> DataFrame:
    """One row per key, the same one in every run."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("na_drop", "SELECT count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def na_drop(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").na.drop(subset=["quality"]).agg(F.count("*").alias("n"))


@query("na_fill", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def na_fill(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.drop("toxic"), "doc_id", "left").na.fill({"quality": -1})


@query("na_replace", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS flag FROM lineitem")
def na_replace(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag")).na.replace({"A": "accepted", "R": "returned"}, subset=["flag"])


@query("generate_posexplode", "SELECT n_nationkey, pos::INT AS pos, letter FROM (SELECT n_nationkey, generate_subscripts(string_split(lower(n_name), ' '), 1) - 1 AS pos, unnest(string_split(lower(n_name), ' ')) AS letter FROM nation)")
def generate_posexplode(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.posexplode(F.split(F.lower("n_name"), " ")).alias("pos", "letter"))


@query("generate_stack", "SELECT r_regionkey, 'name' AS field, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'key', CAST(r_regionkey AS VARCHAR) FROM region")
def generate_stack(t: Tables) -> DataFrame:
    return t.region.selectExpr("r_regionkey", "stack(2, 'name', r_name, 'key', CAST(r_regionkey AS STRING)) AS (field, value)")


@query("generate_inline", "SELECT n_nationkey, a, b FROM (SELECT n_nationkey, unnest([{'a': 1, 'b': n_name}, {'a': 2, 'b': 'x'}], recursive := true) FROM nation)")
def generate_inline(t: Tables) -> DataFrame:
    return t.nation.selectExpr("n_nationkey", "inline(array(struct(1 AS a, n_name AS b), struct(2 AS a, 'x' AS b)))")


@query("generate_explode_map", "SELECT n_nationkey, k AS key, v AS value FROM (SELECT n_nationkey, unnest(['r', 'n']) AS k, unnest([n_regionkey, n_nationkey]) AS v FROM nation)")
def generate_explode_map(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(F.create_map(F.lit("r"), "n_regionkey", F.lit("n"), "n_nationkey")))


@query("unpivot", "SELECT p_partkey, 'p_size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "field", "value")
