"""Joins of every type and strategy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables


def _nation_supplier(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations of even keys against suppliers of nations below 20: both sides have rows without a partner."""
    return t.nation.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), t.supplier.where("s_nationkey < 20").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))


_SIDES = "(SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) a {} JOIN (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier WHERE s_nationkey < 20) b USING (n_nationkey)"

for _kind, _words in (("inner", "INNER"), ("left_outer", "LEFT"), ("right_outer", "RIGHT"), ("full_outer", "FULL")):
    query(f"join_{_kind}", f"SELECT n_nationkey, n_name, s_suppkey FROM {_SIDES.format(_words)}")(lambda t, kind=_kind: (lambda a, b: a.join(b, "n_nationkey", kind).select("n_nationkey", "n_name", "s_suppkey"))(*_nation_supplier(t)))


@query("join_left_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_left_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_cross", "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.nation.select(F.col("n_name").alias("b")))


@query("join_existence", "SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def join_existence(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id").distinct().withColumn("hit", F.lit(True))
    return t.documents.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("labelled"))


both("join_natural", "SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region) NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation)")
both("join_natural_left", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region) b")


@query("join_using", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def join_using(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, ["doc_id"]).select("doc_id", "n_chars", "quality")


_PRICED = "SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40"
for _hint in ("broadcast", "merge", "shuffle_hash"):

    def _hinted(t: Tables, hint: str = _hint) -> DataFrame:
        orders = t.orders.select("o_orderkey", "o_orderstatus")
        if hint == "broadcast":  # nations are few by nature; orders are not, so the small side is picked by hand here
            n = t.nation.select("n_nationkey", "n_name").hint("broadcast")
            return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        return t.lineitem.where("l_quantity > 40").join(orders.hint(hint), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")

    query(f"join_hint_{_hint}", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey" if _hint == "broadcast" else _PRICED)(_hinted)


@query("join_theta_range", "SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 7 GROUP BY r_regionkey")
def join_theta_range(t: Tables) -> DataFrame:
    on = F.col("n_nationkey").between(F.col("r_regionkey") * 3, F.col("r_regionkey") * 3 + 7)
    return F.broadcast(t.region).join(t.nation, on).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("join_cartesian_condition", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_name < b.n_name AND a.n_regionkey = b.n_regionkey")
def join_cartesian_condition(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.col("n_name").alias("a"), "n_regionkey"), t.nation.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("join_star", "SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size < 20 GROUP BY r_name, p_brand")
def join_star(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    rows = line.join(t.part.where("p_size < 20").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("join_outer_coalesce", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY 1) b ON a.k = b.k")
def join_outer_coalesce(t: Tables) -> DataFrame:
    a = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


@query("join_cogroup", "SELECT k, coalesce(max(o), 0) AS orders, coalesce(max(b), 0) AS balance FROM (SELECT o_custkey AS k, count(*) AS o, NULL::DOUBLE AS b FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer) GROUP BY k")
def join_cogroup(t: Tables) -> DataFrame:
    def merge(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "orders": [len(a)], "balance": [float(b["c_acctbal"].iloc[0]) if len(b) else 0.0]})

    orders, customers = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal")
    return orders.groupBy("k").cogroup(customers.groupBy("k")).applyInPandas(merge, "k long, orders long, balance double")


@query("join_lateral_view", "SELECT doc_id, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id")
def join_lateral_view(t: Tables) -> DataFrame:
    return t.sql("SELECT doc_id, count(*) AS n, count(DISTINCT word) AS words FROM documents LATERAL VIEW explode(split(text, ' ')) x AS word GROUP BY doc_id")


@query("join_lateral_view_outer", "SELECT n_nationkey, part FROM (SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [1, 2] ELSE [NULL]::INT[] END) AS part FROM nation)")
def join_lateral_view_outer(t: Tables) -> DataFrame:
    return t.sql("SELECT n_nationkey, part FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_nationkey % 2 = 0 THEN array(1, 2) ELSE CAST(array() AS ARRAY<INT>) END) x AS part")


@query("join_skew_salted", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def join_skew_salted(t: Tables) -> DataFrame:
    """A hot key joined through 16 salts: the small side is repeated, the large side is spread."""
    salts = 16
    kinds = t.events.select("event_type").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = t.events.select("event_type", "user_id", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"))
    return spread.join(kinds, ["event_type", "salt"]).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("join_with_structs", "SELECT n_name AS left_name, r_name AS right_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_with_structs(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.struct("*").alias("l")), t.region.select(F.struct("*").alias("r"))
    return a.join(b, F.col("l.n_regionkey") == F.col("r.r_regionkey")).select(F.col("l.n_name").alias("left_name"), F.col("r.r_name").alias("right_name"))


both("join_pushdown_anti", "SELECT n_nationkey FROM nation a ANTI JOIN region b ON a.n_regionkey = b.r_regionkey AND b.r_regionkey < 2")
