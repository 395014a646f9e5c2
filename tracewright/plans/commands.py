"""Catalogue commands."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


@query("cmd_temp_views", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def cmd_temp_views(t: Tables) -> DataFrame:
    t.nation.where("n_regionkey = 1").createOrReplaceTempView("tw_nations")
    return t.spark.sql("SELECT count(*) AS n FROM tw_nations")


@query("cmd_global_temp_view", "SELECT count(*) AS n FROM region")
def cmd_global_temp_view(t: Tables) -> DataFrame:
    t.region.createOrReplaceGlobalTempView("tw_regions")
    return t.spark.sql("SELECT count(*) AS n FROM global_temp.tw_regions")


@query("cmd_view_using", "SELECT count(*) AS n FROM nation")
def cmd_view_using(t: Tables) -> DataFrame:
    t.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW tw_using USING parquet OPTIONS (path '{t.path('nation')}')")
    t.spark.sql("REFRESH TABLE tw_using")
    return t.spark.sql("SELECT count(*) AS n FROM tw_using")


@query("cmd_show_columns", "SELECT unnest(['n_name', 'n_nationkey', 'n_regionkey']) AS col_name")
def cmd_show_columns(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("tw_columns")
    return t.spark.sql("SHOW COLUMNS IN tw_columns")


@query("cmd_describe", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS col_name, unnest(['int', 'string', 'int']) AS data_type")
def cmd_describe(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("tw_described")
    return t.spark.sql("DESCRIBE tw_described").select("col_name", "data_type")


@query("cmd_functions", "SELECT o_orderkey, o_custkey + 1 AS plus, true AS defined, true AS described, true AS dropped FROM orders")
def cmd_functions(t: Tables) -> DataFrame:
    """A function defined, listed, described, used on all orders and dropped: the query it is in goes on."""
    s = t.spark
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_plus_one(x BIGINT) RETURNS BIGINT RETURN x + 1")
    used = t.sql("SELECT o_orderkey, tw_plus_one(o_custkey) AS plus FROM orders")
    defined = s.sql("SHOW USER FUNCTIONS LIKE 'tw_plus*'").count() == 1 and any(f.name == "tw_plus_one" for f in s.catalog.listFunctions(pattern="tw_plus*"))
    described = s.sql("DESCRIBE FUNCTION tw_plus_one").count() > 0
    s.sql("DROP TEMPORARY FUNCTION tw_plus_one")
    dropped = not s.catalog.functionExists("tw_plus_one")
    return used.select("*", F.lit(defined).alias("defined"), F.lit(described).alias("described"), F.lit(dropped).alias("dropped"))


@query("cmd_set_reset", "SELECT o_orderkey, '7' AS set_value, true AS was_reset FROM orders WHERE o_orderkey % 7 = 0")
def cmd_set_reset(t: Tables) -> DataFrame:
    """A setting that a query is written with; it is gone afterwards, the query keeps its value."""
    s, key = t.spark, "spark.tracewright.note"
    s.sql(f"SET {key}=7")
    value = s.sql(f"SET {key}").first().value
    rows = t.orders.where(F.col("o_orderkey") % int(value) == 0)
    s.sql(f"RESET {key}")
    return rows.select("o_orderkey", F.lit(value).alias("set_value"), F.lit(s.conf.get(key, None) is None).alias("was_reset"))


@query("cmd_variable_substitution", "SELECT o_orderkey, 42 AS answer FROM orders WHERE o_custkey > 42")
def cmd_variable_substitution(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.tracewright.answer", "42")
    return t.sql("SELECT o_orderkey, ${spark.tracewright.answer} AS answer FROM orders WHERE o_custkey > ${spark.tracewright.answer}")


@query("cmd_cache", "SELECT true AS cached, true AS uncached, 25 AS n")
def cmd_cache(t: Tables) -> DataFrame:
    s = t.spark
    t.nation.createOrReplaceTempView("tw_cached")
    s.sql("CACHE TABLE tw_cached")
    cached, n = s.catalog.isCached("tw_cached"), s.table("tw_cached").where("n_nationkey >= 0").count()
    s.sql("UNCACHE TABLE tw_cached")
    return s.createDataFrame([(cached, not s.catalog.isCached("tw_cached"), n)], "cached boolean, uncached boolean, n int")


@query("cmd_databases", "SELECT o_orderstatus, count(*) AS n, true AS listed, true AS current, true AS gone FROM orders GROUP BY 1")
def cmd_databases(t: Tables) -> DataFrame:
    """A database of our own: created, used, filled by a query, listed, and dropped with its table."""
    s, name = t.spark, f"tw_{uuid.uuid4().hex[:12]}"
    before = s.catalog.currentDatabase()
    t.orders.createOrReplaceTempView("tw_all_orders")
    s.sql(f"CREATE DATABASE {name} COMMENT 'orders by state'")
    try:
        s.sql(f"USE {name}")
        s.sql("CREATE TABLE by_state USING parquet AS SELECT o_orderstatus, count(*) AS n FROM tw_all_orders GROUP BY 1")
        listed = s.sql(f"SHOW DATABASES LIKE '{name}'").count() == 1 and s.sql(f"SHOW TABLES IN {name} LIKE 'by_*'").count() == 1 and s.catalog.tableExists(f"{name}.by_state")
        current = s.catalog.currentDatabase() == name
        rows = s.sql("SELECT o_orderstatus, n FROM by_state").collect()  # a row per state
    finally:
        s.sql(f"USE {before}")
        s.sql(f"DROP DATABASE {name} CASCADE")
    gone = not s.catalog.databaseExists(name)
    return s.createDataFrame([(r.o_orderstatus, r.n, listed, current, gone) for r in rows], "o_orderstatus string, n long, listed boolean, current boolean, gone boolean")


@query("cmd_tables_and_statistics", "SELECT 25 AS n, true AS analysed, true AS bucketed, true AS gone")
def cmd_tables_and_statistics(t: Tables) -> DataFrame:
    """A managed, bucketed table with table and column statistics; dropped afterwards."""
    s = t.spark
    s.sql("DROP TABLE IF EXISTS tw_managed")
    t.nation.write.bucketBy(2, "n_nationkey").sortBy("n_nationkey").saveAsTable("tw_managed")
    s.sql("ANALYZE TABLE tw_managed COMPUTE STATISTICS")
    s.sql("ANALYZE TABLE tw_managed COMPUTE STATISTICS FOR COLUMNS n_nationkey")
    about = {r.col_name: r.data_type for r in s.sql("DESCRIBE EXTENDED tw_managed").collect()}
    n = s.table("tw_managed").count()
    s.sql("DROP TABLE tw_managed")
    return s.createDataFrame([(n, "25 rows" in about.get("Statistics", ""), about.get("Num Buckets") == "2", not s.catalog.tableExists("tw_managed"))], "n int, analysed boolean, bucketed boolean, gone boolean")


@query("cmd_insert_into", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cmd_insert_into(t: Tables) -> DataFrame:
    s = t.spark
    s.sql("DROP TABLE IF EXISTS tw_insert")
    s.sql("CREATE TABLE tw_insert (n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey)")
    t.nation.where("n_nationkey < 12").createOrReplaceTempView("tw_first")
    s.sql("INSERT INTO tw_insert SELECT n_name, n_regionkey FROM tw_first")
    t.nation.where("n_nationkey >= 12").select("n_name", "n_regionkey").write.insertInto("tw_insert")
    rows = [(r.n_regionkey, r.n) for r in s.table("tw_insert").groupBy("n_regionkey").agg(F.count("*").alias("n")).collect()]  # a row per region
    s.sql("DROP TABLE tw_insert")
    return s.createDataFrame(rows, "n_regionkey int, n long")


@query("cmd_explain", "SELECT true AS pushed, true AS pruned")
def cmd_explain(t: Tables) -> DataFrame:
    """The filter and the two columns reach the scan."""
    plan = t.lineitem.where("l_quantity > 49").select("l_orderkey", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    pushed, pruned = "GreaterThan(l_quantity" in plan, "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    return t.spark.createDataFrame([(pushed, pruned)], "pushed boolean, pruned boolean")


@query("cmd_add_and_list_files", "SELECT o_orderpriority, count(*) AS n, true AS listed, true AS listed_jar FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING min(o_custkey) < 3) GROUP BY 1")
def cmd_add_and_list_files(t: Tables) -> DataFrame:
    """A file and an archive are shipped to all executors; a function there reads its words from the file."""
    s, tag, local = t.spark, uuid.uuid4().hex[:12], tempfile.mkdtemp(prefix="tracewright-")
    words, jar = os.path.join(local, f"words-{tag}.txt"), os.path.join(local, f"empty-{tag}.jar")
    with open(words, "w") as f:
        f.writelines(r[0] + "\n" for r in t.orders.groupBy("o_orderpriority").agg(F.min("o_custkey").alias("k")).where("k < 3").select("o_orderpriority").collect())  # five at most
    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\n")
    s.sql(f"ADD FILE '{words}'")
    s.sql(f"ADD JAR '{jar}'")
    listed, listed_jar = (any(tag in r[0] for r in s.sql(f"LIST {kind}").collect()) for kind in ("FILES", "JARS"))

    @F.pandas_udf("boolean")
    def shipped(word: pd.Series) -> pd.Series:
        with open(SparkFiles.get(f"words-{tag}.txt")) as f:
            return word.isin(f.read().splitlines())

    return t.orders.where(shipped("o_orderpriority")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.lit(listed).alias("listed"), F.lit(listed_jar).alias("listed_jar"))
