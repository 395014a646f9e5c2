"""Aggregation: grouping, grouping sets, pivots, distinct and typed aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..registry import both, query
from ..sources.tables import Tables

_PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query("agg_pricing_summary", _PRICING)
def agg_pricing_summary(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )
    return rows.orderBy("l_returnflag", "l_linestatus")


@query("agg_basic", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_suppkey")
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("agg_null_group", "SELECT l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality")
def agg_null_group(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


@query("agg_moments", "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS sd_samp, round(stddev_pop(l_quantity), 5) AS sd_pop, round(var_samp(l_quantity), 5) AS v_samp, round(var_pop(l_quantity), 5) AS v_pop FROM lineitem GROUP BY l_returnflag")
def agg_moments(t: Tables) -> DataFrame:
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp(q), 5).alias("sd_samp"), F.round(F.stddev_pop(q), 5).alias("sd_pop"), F.round(F.var_samp(q), 5).alias("v_samp"), F.round(F.var_pop(q), 5).alias("v_pop"))


@query("agg_skewness_kurtosis", """WITH m AS (SELECT l_returnflag, l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS d FROM lineitem)
SELECT l_returnflag, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 5) AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 5) AS kurt FROM m GROUP BY l_returnflag""")
def agg_skewness_kurtosis(t: Tables) -> DataFrame:
    x = F.col("l_extendedprice") / 1000
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.skewness(x), 5).alias("skew"), F.round(F.kurtosis(x), 5).alias("kurt"))


@query("agg_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_extendedprice), 3) AS c_pop, round(covar_samp(l_quantity, l_extendedprice), 3) AS c_samp FROM lineitem GROUP BY l_returnflag")
def agg_correlation(t: Tables) -> DataFrame:
    a, b = "l_quantity", "l_extendedprice"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr(a, b), 6).alias("r"), F.round(F.covar_pop(a, b), 3).alias("c_pop"), F.round(F.covar_samp(a, b), 3).alias("c_samp"))


@query("agg_distinct_many", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
def agg_distinct_many(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("lines"))


_COURSES = "SELECT p_brand, year(l_shipdate)::INT AS y, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5"


def _courses(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("q"))


_SETS = "SELECT p_brand, y, round(sum(q), 2) AS total, grouping(p_brand)::INT AS g_brand, grouping(y)::INT AS g_year, (grouping(p_brand) * 2 + grouping(y))::BIGINT AS gid FROM ({}) GROUP BY {}"


def _with_grouping(grouped) -> DataFrame:
    return grouped.agg(F.round(F.sum("q"), 2).alias("total"), F.grouping("p_brand").cast("int").alias("g_brand"), F.grouping("y").cast("int").alias("g_year"), F.grouping_id().alias("gid"))


@query("agg_rollup", _SETS.format(_COURSES, "ROLLUP (p_brand, y)"))
def agg_rollup(t: Tables) -> DataFrame:
    return _with_grouping(_courses(t).rollup("p_brand", "y"))


@query("agg_cube", _SETS.format(_COURSES, "CUBE (p_brand, y)"))
def agg_cube(t: Tables) -> DataFrame:
    return _with_grouping(_courses(t).cube("p_brand", "y"))


@query("agg_grouping_sets", _SETS.format(_COURSES, "GROUPING SETS ((p_brand), (y), ())"))
def agg_grouping_sets(t: Tables) -> DataFrame:
    rows = _courses(t)
    return _with_grouping(rows.groupingSets([["p_brand"], ["y"], []], "p_brand", "y"))


both("agg_cube_overlapping", "SELECT l_returnflag, l_linestatus, l_linenumber % 2 AS odd, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber % 2), (l_returnflag))")


@query("agg_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS \"F\", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS \"O\" FROM lineitem GROUP BY l_returnflag")
def agg_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("agg_pivot_found_values", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def agg_pivot_found_values(t: Tables) -> DataFrame:
    """Values are found by the engine first; as missing cells are null there, they are filled."""
    wide = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority").count()
    return wide.select("o_orderstatus", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) if c in wide.columns else F.lit(0).cast("long").alias(n) for c, n in (("1-URGENT", "urgent"), ("5-LOW", "low"))])


@query("agg_collect_sorted", "SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT length(n_name)::INT)) AS sizes FROM nation GROUP BY n_regionkey")
def agg_collect_sorted(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.sort_array(F.collect_set(F.length("n_name"))).alias("sizes"))


@query("agg_first_last_by", "SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[1] AS cheapest, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC)[1] AS dearest FROM orders GROUP BY o_custkey")
def agg_first_last_by(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"))


@query("agg_percentile_exact", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_percentile_exact(t: Tables) -> DataFrame:
    p = F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.percentile(p, 0.5), 4).alias("p50"), F.round(F.percentile(p, 0.9), 4).alias("p90"))


@query("agg_filtered", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_filtered(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")


@query("agg_pandas_udaf", "SELECT n_regionkey, max(length(n_name))::BIGINT - min(length(n_name))::BIGINT AS spread FROM nation GROUP BY n_regionkey")
def agg_pandas_udaf(t: Tables) -> DataFrame:
    @F.pandas_udf("long")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return t.nation.groupBy("n_regionkey").agg(spread(F.length("n_name").cast("long")).alias("spread"))


@query("agg_reduce_groups", "SELECT n_regionkey, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def agg_reduce_groups(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.max("n_name").alias("last"))


@query("agg_approx_distinct", "SELECT true AS close")
def agg_approx_distinct(t: Tables) -> DataFrame:
    """Within four relative standard deviations of the exact count."""
    rsd = 0.02
    return t.lineitem.agg((F.abs(F.approx_count_distinct("l_partkey", rsd) / F.countDistinct("l_partkey") - 1) <= 4 * rsd).alias("close"))


@query("agg_percentile_approx", "SELECT true AS close")
def agg_percentile_approx(t: Tables) -> DataFrame:
    """The rank of the sketch's median is within its stated error of one half."""
    sketch = t.lineitem.agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("m"))
    rank = t.lineitem.join(F.broadcast(sketch)).agg(F.avg((F.col("l_extendedprice") <= F.col("m")).cast("double")).alias("r"))
    return rank.select((F.abs(F.col("r") - 0.5) <= 0.01).alias("close"))


@query("agg_count_min_sketch", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def agg_count_min_sketch(t: Tables) -> DataFrame:
    """A sketch wide enough for its few keys counts them exactly."""
    found = t.lineitem.agg(F.count_min_sketch(F.col("l_linenumber").cast("long"), F.lit(0.001), F.lit(0.99), F.lit(42)).alias("s")).first().s
    sketch = t.spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(found)
    keys = [r[0] for r in t.lineitem.select("l_linenumber").distinct().collect()]  # seven
    return t.spark.createDataFrame([(k, sketch.estimateCount(k)) for k in keys], "l_linenumber int, n long")


@query("agg_spread_names", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS deviation, round(stddev_samp(l_tax), 8) AS deviation_of_tax, round(var_samp(l_quantity), 5) AS spread FROM lineitem GROUP BY 1")
def agg_spread_names(t: Tables) -> DataFrame:
    """The short names: mean, stddev, std, variance."""
    return t.sql("SELECT l_returnflag, round(mean(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS deviation, round(std(l_tax), 8) AS deviation_of_tax, round(variance(l_quantity), 5) AS spread FROM lineitem GROUP BY 1")


@query("agg_few_rows", "SELECT n_regionkey AS n, CASE WHEN count(*) > 1 THEN corr(a, b) END AS r, covar_samp(a, b) AS s, covar_pop(a, b) AS p FROM (SELECT n_regionkey, n_nationkey::DOUBLE AS a, 2 * n_nationkey::DOUBLE AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i = 1 GROUP BY 1")
def agg_few_rows(t: Tables) -> DataFrame:
    """Of one row there is no correlation and no sample covariance; its own covariance is 0."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    one = t.nation.withColumn("i", F.row_number().over(w)).where("i = 1").select("n_regionkey", F.col("n_nationkey").cast("double").alias("a"), (F.col("n_nationkey") * 2.0).alias("b"))
    return one.groupBy(F.col("n_regionkey").alias("n")).agg(F.corr("a", "b").alias("r"), F.covar_samp("a", "b").alias("s"), F.covar_pop("a", "b").alias("p"))


@query("agg_first_ignoring_nulls", "SELECT n_regionkey, min(n_nationkey) FILTER (n_nationkey > 9) AS first, max(n_nationkey) FILTER (n_nationkey < 15) AS last FROM nation GROUP BY 1")
def agg_first_ignoring_nulls(t: Tables) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("n_nationkey") > 9, F.col("n_nationkey")), ignorenulls=True).over(w)
    last = F.last(F.when(F.col("n_nationkey") < 15, F.col("n_nationkey")), ignorenulls=True).over(w)
    return t.nation.select("n_regionkey", first.alias("first"), last.alias("last")).distinct()


def bloom_size(keys: int, rate: float = 0.03) -> tuple[int, int]:
    """Bits (whole words) and hash functions for a number of keys and a rate of false positives."""
    bits = max(64, math.ceil(-max(keys, 1) * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def bloom_filters(keys: DataFrame, key: str, shards: int, bits: int, hashes: int) -> DataFrame:
    """(shard, words): per shard of the keys one filter as a packed array of 64-bit words.

    Words are set where the keys are and merged by (shard, word); no task holds more than one
    shard's words.
    """
    place = F.explode(_bloom_slots(F.col(key), bits, hashes))
    slots = keys.where(F.col(key).isNotNull()).select(_bloom_shard(F.col(key), shards).alias("shard"), place.alias("slot"))
    words = slots.groupBy("shard", (F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits"))
    found = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    return found.select("shard", F.expr(f"transform(sequence(0, {bits // 64 - 1}), i -> coalesce(try_element_at(found, i), 0L))").alias("words"))


def _bloom_shard(key, shards: int):
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


def _bloom_slots(key, bits: int, hashes: int):
    """Double hashing: two hashes make all places of a key."""
    one, two = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.array(*[F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)])


def bloom_thinned(rows: DataFrame, key: str, keys: DataFrame, rate: float = 0.03, shard_bits: int = 1 << 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows whose key may be among `keys` (column of the same name): all that are, and about `rate` of the others.

    The filter is sized from the counted keys and dealt into shards of at most `shard_bits`.
    Below `broadcast_bytes` the shards are broadcast; a larger filter would cost every executor
    more than it saves, and the rows come back as they are, for the join to decide.
    """
    count = keys.where(F.col(key).isNotNull()).agg(F.count("*")).first()[0]
    total, hashes = bloom_size(count, rate)
    if total // 8 > broadcast_bytes:
        return rows
    shards = max(1, -(-total // shard_bits))
    bits = -(-total // shards // 64) * 64 + (64 if shards > 1 else 0)  # shards are uneven by a little
    filters = bloom_filters(keys, key, shards, bits, hashes)
    met = rows.withColumn("shard", _bloom_shard(F.col(key), shards)).join(F.broadcast(filters), "shard")
    hit = F.forall(_bloom_slots(F.col(key), bits, hashes), lambda s: F.expr("words")[(s / 64).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))) != 0)
    return met.where(F.col(key).isNotNull() & hit).drop("shard", "words")


@query("agg_bloom_filter", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def agg_bloom_filter(t: Tables) -> DataFrame:
    """A Bloom filter sized from its keys thins the large side, the join removes its false positives."""
    keys = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"))
    return bloom_thinned(t.orders.select(F.col("o_custkey").alias("k")), "k", keys).join(keys, "k", "left_semi").agg(F.count("*").alias("n"))


@query("agg_histogram_even", "SELECT least(floor((l_quantity - 1) / ((50 - 1) / 7.0)), 6)::BIGINT AS bucket, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def agg_histogram_even(t: Tables) -> DataFrame:
    """Even buckets over [1, 50]; the last one is closed."""
    at = F.least(F.floor((F.col("l_quantity") - 1) / ((50 - 1) / 7.0)), F.lit(6).cast("long"))
    return t.lineitem.where(F.col("l_quantity").between(1, 50)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_histogram_buckets", "SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def agg_histogram_buckets(t: Tables) -> DataFrame:
    edges = [0, 5, 20, 50]
    at = F.coalesce(*[F.when(F.col("l_quantity") < e, F.lit(i)) for i, e in enumerate(edges[1:])], F.lit(len(edges) - 2))
    return t.lineitem.where(F.col("l_quantity").between(edges[0], edges[-1])).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_mean_approx", "SELECT true AS covered")
def agg_mean_approx(t: Tables) -> DataFrame:
    """A normal interval (six standard errors) from a sample holds the exact mean."""
    s = t.lineitem.sample(False, 0.2, seed=5).agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("e"))
    return s.join(F.broadcast(t.lineitem.agg(F.avg("l_quantity").alias("x")))).select((F.abs(F.col("m") - F.col("x")) <= 6 * F.col("e")).alias("covered"))


@query("agg_count_approx_by_value", "SELECT l_returnflag, true AS covered FROM lineitem GROUP BY l_returnflag")
def agg_count_approx_by_value(t: Tables) -> DataFrame:
    share = 0.2
    s = t.lineitem.sample(False, share, seed=9).groupBy("l_returnflag").agg(F.count("*").alias("k"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    bound = 6 * F.sqrt(F.col("n") * share * (1 - share)) / share
    return exact.join(s, "l_returnflag").select("l_returnflag", (F.abs(F.col("k") / share - F.col("n")) <= bound).alias("covered"))


@query("agg_observe_accumulator", "SELECT count(*) AS rows, count(*) FILTER (l_quantity > 25) AS large, count(*) FILTER (l_quantity > 25) AS n FROM lineitem")
def agg_observe_accumulator(t: Tables) -> DataFrame:
    """Counters collected on the way (an accumulator), read after the action beside its unchanged result.

    In a session of its own: one that has observed cannot ship fitted models to its executors.
    """
    seen = Observation("seen")
    rows = Tables(t.spark.newSession(), t.sf_dir).lineitem.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("large"))
    n = rows.where("l_quantity > 25").count()
    return t.spark.createDataFrame([(seen.get["rows"], seen.get["large"], n)], "rows long, large long, n long")


@query("agg_top_by_key", "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 3")
def agg_top_by_key(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    return t.lineitem.select("l_suppkey", "l_extendedprice").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
