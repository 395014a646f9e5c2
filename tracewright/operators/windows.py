"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables

@query("win_ranking", """SELECT p_partkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER v AS q
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), v AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""".replace("row_number() OVER w", "row_number() OVER v"))
def win_ranking(t: Tables) -> DataFrame:
    w, v = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return t.part.select(
        "p_partkey", F.row_number().over(v).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"),
        F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"), F.ntile(4).over(v).cast("long").alias("q"),
    )


@query("win_offset", "SELECT p_partkey, lag(p_size, 1, -1) OVER w AS before, lead(p_size, 2) OVER w AS after, first_value(p_size) OVER w AS first, last_value(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def win_offset(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.part.select("p_partkey", F.lag("p_size", 1, -1).over(w).alias("before"), F.lead("p_size", 2).over(w).alias("after"), F.first("p_size").over(w).alias("first"), F.last("p_size").over(whole).alias("last"))


@query("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM orders")
def win_rows_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 1)), 2).alias("near"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def win_range_frame(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("win_default_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS running, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS whole FROM lineitem")
def win_default_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w.orderBy("l_linenumber")), 2).alias("running"), F.round(F.sum("l_quantity").over(w), 2).alias("whole"))


both("win_named_clause", "SELECT n_nationkey, CAST(rank() OVER w AS BIGINT) AS r, max(n_name) OVER w AS m FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
both("win_null_ordering", "SELECT d.doc_id, CAST(row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY l.quality ASC NULLS FIRST, d.doc_id) AS BIGINT) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("win_share_of_total", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS peers, n_nationkey * 100 / (sum(n_nationkey) OVER (PARTITION BY n_regionkey)) > 20 AS large FROM nation")


@query("win_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def win_tumbling(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("win_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, ts FROM events) GROUP BY s")
def win_sliding(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("win_offset_start", "SELECT time_bucket(INTERVAL 1 DAY, ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR AS start, round(sum(value), 4) AS total FROM events GROUP BY 1")
def win_offset_start(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 day", "1 day", "3 hours").alias("w")).agg(F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "total")


@query("win_session", """SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def win_session(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return rows.select("user_id", "first_ts", "n")


@query("win_sliding_lists", "SELECT p_partkey, list(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS next_sizes FROM part")
def win_sliding_lists(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.collect_list("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(0, 2)).alias("next_sizes"))
