"""Descriptive statistics of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


@query("stat_crosstab", "SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def stat_crosstab(t: Tables) -> DataFrame:
    return t.lineitem.crosstab("l_returnflag", "l_linestatus").withColumnRenamed("l_returnflag_l_linestatus", "flag")


@query("stat_freq_items", "SELECT true AS holds_all")
def stat_freq_items(t: Tables) -> DataFrame:
    """Every value of at least the support is reported; others may be."""
    found = t.lineitem.freqItems(["l_returnflag"], 0.1).select(F.col("l_returnflag_freqItems").alias("items"))
    n = t.lineitem.agg(F.count("*").alias("n"))
    often = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("k")).join(F.broadcast(n)).where("k > 0.1 * n").agg(F.collect_set("l_returnflag").alias("often"))
    return found.join(often).select((F.size(F.array_except("often", "items")) == 0).alias("holds_all"))


@query("stat_approx_quantile", "SELECT true AS close")
def stat_approx_quantile(t: Tables) -> DataFrame:
    low, high = t.lineitem.approxQuantile("l_extendedprice", [0.25, 0.75], 0.005)
    share = t.lineitem.agg(F.avg((F.col("l_extendedprice") <= low).cast("double")).alias("a"), F.avg((F.col("l_extendedprice") <= high).cast("double")).alias("b"))
    return share.select(((F.abs(F.col("a") - 0.25) <= 0.01) & (F.abs(F.col("b") - 0.75) <= 0.01)).alias("close"))


@query("stat_corr_cov", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS c FROM lineitem")
def stat_corr_cov(t: Tables) -> DataFrame:
    r, c = t.lineitem.stat.corr("l_quantity", "l_extendedprice"), t.lineitem.stat.cov("l_quantity", "l_extendedprice")
    return t.spark.createDataFrame([(r, c)], "r double, c double").select(F.round("r", 6).alias("r"), F.round("c", 2).alias("c"))


@query("stat_describe", "SELECT count(l_quantity)::VARCHAR AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def stat_describe(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity").describe()
    one = rows.groupBy().pivot("summary", ["count", "mean", "stddev", "min", "max"]).agg(F.first("l_quantity"))
    return one.select(F.col("count").alias("n"), F.round(F.col("mean").cast("double"), 6).alias("mean"), F.round(F.col("stddev").cast("double"), 6).alias("sd"), F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"))


@query("stat_summary_quartiles", "SELECT count(*)::VARCHAR AS n FROM customer")
def stat_summary_quartiles(t: Tables) -> DataFrame:
    return t.customer.select("c_acctbal").summary("count", "25%", "75%").where("summary = 'count'").select(F.col("c_acctbal").alias("n"))


@query("stat_column_profile", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments, count(*) - count(c_name) AS null_names, max(length(c_name))::INT AS widest FROM customer")
def stat_column_profile(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"), (F.count("*") - F.count("c_name")).alias("null_names"), F.max(F.length("c_name")).alias("widest"))
