"""Record-at-a-time transformations and actions, said with DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


def zip_with_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Global positions along an order without sorting everything in one task.

    Range partitions are sorted apart and numbered inside; a partition's base is
    the sum of the sizes before it (one row per partition).
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    base = sizes.withColumn("_base", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_base", F.lit(0)).alias("_base"))
    return parts.withColumn("_at", F.row_number().over(own)).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at") - 1).drop("_part", "_at", "_base")


@query("rdd_map_flatmap_reduce", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(n_name), ' ')) AS word FROM nation) GROUP BY word")
def rdd_map_flatmap_reduce(t: Tables) -> DataFrame:
    return t.nation.select(F.explode(F.split(F.lower("n_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("rdd_map_partitions", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def rdd_map_partitions(t: Tables) -> DataFrame:
    def double(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(doubled=p.o_totalprice * 2)[["o_orderkey", "doubled"]]

    return t.orders.select("o_orderkey", "o_totalprice").mapInPandas(double, "o_orderkey long, doubled double")


@query("rdd_map_partitions_with_index", "SELECT o_orderkey % 3 AS k, count(*) AS n, sum(o_totalprice)::DECIMAL(20, 2)::DOUBLE AS total FROM orders GROUP BY 1")
def rdd_map_partitions_with_index(t: Tables) -> DataFrame:
    """Rows dealt by key: each key lies in one partition, whose index goes with its rows."""
    rows = t.orders.select((F.col("o_orderkey") % 3).alias("k"), "o_totalprice").repartition(5, "k").withColumn("p", F.spark_partition_id())
    by = rows.groupBy("p", "k").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("total"))
    return by.groupBy("k").agg(F.sum(F.when(F.col("p").isNotNull(), F.col("n"))).alias("n"), F.sum("total").cast("double").alias("total"))


@query("rdd_glom", "SELECT list_sort(list(n_name)) AS names, count(*) AS n FROM nation")
def rdd_glom(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("n_name").alias("names")).agg(F.array_sort(F.flatten(F.collect_list("names"))).alias("names"), F.sum(F.size("names")).alias("n"))


@query("rdd_group_by_key", "SELECT n_regionkey AS k, list_sort(list(n_name)) AS v FROM nation GROUP BY n_regionkey")
def rdd_group_by_key(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("v"))


@query("rdd_combine_by_key", "SELECT c_nationkey AS k, count(*) AS n, round(sum(c_acctbal) / count(*), 4) AS mean FROM customer GROUP BY c_nationkey")
def rdd_combine_by_key(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal") / F.count("*"), 4).alias("mean"))


@query("rdd_fold_aggregate", "SELECT max(c_acctbal) AS high, min(c_acctbal) AS low, count(*) AS n FROM customer")
def rdd_fold_aggregate(t: Tables) -> DataFrame:
    return t.customer.agg(F.max("c_acctbal").alias("high"), F.min("c_acctbal").alias("low"), F.count("*").alias("n"))


@query("rdd_count_by_value", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment")
def rdd_count_by_value(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))


@query("rdd_zip_with_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS index FROM customer")
def rdd_zip_with_index(t: Tables) -> DataFrame:
    return zip_with_index(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "index")


@query("rdd_zip_with_unique_id", "SELECT count(*) AS n, count(*) AS ids, count(DISTINCT o_orderkey) AS keys FROM orders")
def rdd_zip_with_unique_id(t: Tables) -> DataFrame:
    return t.orders.withColumn("id", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("o_orderkey").alias("keys"))


@query("rdd_zip", "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_name DESC) AS i FROM nation) b USING (i)")
def rdd_zip(t: Tables) -> DataFrame:
    a = zip_with_index(t.nation.select(F.col("n_nationkey").alias("left_key")), ["left_key"])
    b = zip_with_index(t.nation.select(F.col("n_nationkey").alias("right_key"), F.col("n_name").alias("o")), ["o"])
    last = t.nation.count() - 1
    return a.join(b.withColumn("index", F.lit(last) - F.col("index")), "index").select("left_key", "right_key")


@query("rdd_pipe", "SELECT upper(n_name) AS line FROM nation")
def rdd_pipe(t: Tables) -> DataFrame:
    """Rows through an external program; Spark SQL's TRANSFORM needs no RDD."""
    return t.sql("SELECT TRANSFORM(n_name) USING 'tr a-z A-Z' AS (line STRING) FROM nation")


@query("rdd_sliding", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)::BIGINT AS s FROM part")
def rdd_sliding(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.sum("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(0, 3)).alias("s"))


@query("rdd_subtract_by_key", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rdd_subtract_by_key(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rdd_checkpoint", "SELECT count(*) AS n FROM orders")
def rdd_checkpoint(t: Tables) -> DataFrame:
    from ..plans.storage import reliable

    return reliable(t.orders.select("o_orderkey")).agg(F.count("*").alias("n"))


@query("rdd_broadcast_variable", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS label FROM nation")
def rdd_broadcast_variable(t: Tables) -> DataFrame:
    names = t.spark.sparkContext.broadcast({0: "zero", 1: "one"})

    @F.pandas_udf("string")
    def label(k: pd.Series) -> pd.Series:
        return k.map(names.value).fillna("more")

    return t.nation.select("n_name", label("n_regionkey").alias("label"))


@query("rdd_stat_counter", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high FROM events")
def rdd_stat_counter(t: Tables) -> DataFrame:
    v = "value"
    return t.events.agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("rdd_async_actions", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers")
def rdd_async_actions(t: Tables) -> DataFrame:
    """Independent actions run at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.submit(t.orders.count), pool.submit(t.customer.count)
        return t.spark.createDataFrame([(a.result(), b.result())], "orders long, customers long")


@query("rdd_foreach_partition", "SELECT count(*) AS n FROM nation")
def rdd_foreach_partition(t: Tables) -> DataFrame:
    """A side effect per partition, counted by an accumulator."""
    seen = t.spark.sparkContext.accumulator(0)

    def count(rows) -> None:
        seen.add(sum(1 for _ in rows))

    t.nation.foreachPartition(count)
    return t.spark.createDataFrame([(seen.value,)], "n long")
