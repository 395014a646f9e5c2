"""Reader and writer options of CSV and JSON, and rows of an RDD as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .connectors import folder
from .tables import Tables


def _lines(t: Tables, name: str, *parts: DataFrame) -> str:
    """A folder of text files, one line per value."""
    path = folder(t, name)
    for part in parts:
        part.coalesce(1).write.mode("append").text(path)
    return path


@query("source_csv_quotes", "SELECT n_nationkey AS k, 'a \"b\"; ' || n_name AS v FROM nation")
def source_csv_quotes(t: Tables) -> DataFrame:
    """Own separator, quote and escape: the separator and the quote itself stand inside quoted values."""
    rows = t.nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit('a "b"; '), "n_name").alias("v"))
    path, how = folder(t, "csv-quotes"), {"sep": ";", "quote": '"', "escape": "\\", "quoteAll": "true", "header": "true"}
    rows.write.options(**how).csv(path)
    return t.spark.read.options(**how).schema(rows.schema).csv(path)


@query("source_csv_nulls_dates", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS d FROM orders")
def source_csv_nulls_dates(t: Tables) -> DataFrame:
    """A text for null and a date format, both ways."""
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 > 0, F.to_date("o_orderdate")).alias("d"))
    path, how = folder(t, "csv-dates"), {"nullValue": "n/a", "dateFormat": "dd/MM/yyyy"}
    rows.write.options(**how).csv(path)
    return t.spark.read.options(**how).schema("k long, d date").csv(path)


@query("source_csv_comments_spaces", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def source_csv_comments_spaces(t: Tables) -> DataFrame:
    """Comment lines are left out, white space around values goes."""
    body = t.nation.select(F.concat_ws(" , ", F.concat(F.lit("  "), F.col("n_nationkey").cast("string")), F.concat("n_name", F.lit("   "))).alias("value"))
    path = _lines(t, "csv-comments", t.spark.createDataFrame([("# a note, with a comma",), ("#",)], "value string"), body)
    how = {"comment": "#", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return t.spark.read.options(**how).schema("k int, v string").csv(path)


@query("source_csv_inferred_multiline", "SELECT n_nationkey::INT AS k, n_name || chr(10) || 'x' AS v FROM nation")
def source_csv_inferred_multiline(t: Tables) -> DataFrame:
    """Line breaks inside quoted values, and a schema read from the data."""
    path = folder(t, "csv-lines")
    t.nation.select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit("\nx")).alias("v")).write.option("header", True).csv(path)
    return t.spark.read.options(header="true", multiLine="true", inferSchema="true").csv(path)


@query("source_csv_corrupt_column", "SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'x,' || n_name END AS bad FROM nation")
def source_csv_corrupt_column(t: Tables) -> DataFrame:
    """What cannot be read is kept in a column of its own."""
    path = _lines(t, "csv-corrupt", t.nation.select(F.concat_ws(",", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey").cast("string")).otherwise("x"), "n_name").alias("value")))
    rows = t.spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord="bad").schema("k long, name string, bad string").csv(path)
    return rows.select("k", "name", "bad").select("k", "bad")


def _objects(t: Tables, form: str) -> DataFrame:
    return t.nation.select(F.format_string(form, "n_nationkey", "n_name").alias("value"))


@query("source_json_relaxed", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def source_json_relaxed(t: Tables) -> DataFrame:
    """Comments, single quotes, names without quotes and leading zeros are read where they are allowed."""
    path = _lines(t, "json-relaxed", _objects(t, "/* note */ {k: 00%d, 'v': '%s'}"))
    how = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNumericLeadingZeros": "true"}
    return t.spark.read.options(**how).schema("k long, v string").json(path)


@query("source_json_primitives_as_string", "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def source_json_primitives_as_string(t: Tables) -> DataFrame:
    return t.spark.read.option("primitivesAsString", True).json(_lines(t, "json-strings", _objects(t, '{"k": %d, "v": "%s"}'))).select("k", "v")


@query("source_json_prefers_decimal", "SELECT true AS is_decimal, sum(n_nationkey + 0.5)::DOUBLE AS total FROM nation")
def source_json_prefers_decimal(t: Tables) -> DataFrame:
    rows = t.spark.read.option("prefersDecimal", True).json(_lines(t, "json-decimal", _objects(t, '{"k": %d.5, "v": "%s"}')))
    return rows.agg(F.lit(rows.schema["k"].dataType.typeName() == "decimal").alias("is_decimal"), F.sum("k").cast("double").alias("total"))


@query("source_json_corrupt_column", "SELECT CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END AS k, n_nationkey % 3 = 0 AS broken FROM nation")
def source_json_corrupt_column(t: Tables) -> DataFrame:
    rows = _objects(t, '{"k": %d, "v": "%s"}').withColumn("value", F.when(F.get_json_object("value", "$.k").cast("long") % 3 == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")))
    found = t.spark.read.schema("k long, v string, _corrupt_record string").json(_lines(t, "json-corrupt", rows))
    return found.select(F.when(F.col("_corrupt_record").isNull(), F.col("k")).alias("k"), F.col("_corrupt_record").isNotNull().alias("broken"))


@query("source_json_dates_multiline", "SELECT n_nationkey AS k, DATE '2024-01-01' + n_nationkey::INT AS d FROM nation")
def source_json_dates_multiline(t: Tables) -> DataFrame:
    """One array over many lines, with dates in a format of their own."""
    path = folder(t, "json-array")
    rows = t.nation.select("n_nationkey", F.date_format(F.expr("DATE '2024-01-01' + int(n_nationkey)"), "dd.MM.yyyy").alias("d"))
    body = rows.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.format_string('{"k": %d,\n "d": "%s"}', "n_nationkey", "d")), ",\n"), F.lit("\n]")).alias("value"))  # 25 rows
    body.coalesce(1).write.text(path)
    return t.spark.read.options(multiLine="true", dateFormat="dd.MM.yyyy").schema("k long, d date").json(path)


@query("source_rdd_rows", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def source_rdd_rows(t: Tables) -> DataFrame:
    """A table over the rows of an RDD, which exist only in the RDD API."""
    return t.spark.createDataFrame(t.nation.select("n_nationkey", "n_name").rdd.map(tuple), "k int, v string")


@query("source_filter_language", "SELECT p_partkey FROM part WHERE p_size IN (3, 9) AND p_name LIKE '%a%' AND p_retailprice BETWEEN 1000 AND 1800 AND p_brand IS NOT NULL AND NOT p_type = 'x' AND (p_size > 5 OR p_partkey < 400)")
def source_filter_language(t: Tables) -> DataFrame:
    """The language of filters that a scan takes: in, contains, ranges, null tests, not, or."""
    rows = t.part.where(F.col("p_size").isin(3, 9) & F.col("p_name").contains("a") & F.col("p_retailprice").between(1000, 1800) & F.col("p_brand").isNotNull() & ~(F.col("p_type") == "x") & ((F.col("p_size") > 5) | (F.col("p_partkey") < 400)))
    reached = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0).dataFilters().mkString(" ")
    if not all(x in reached for x in ("IN (3,9)", "Contains(", ">=", "isnotnull(", "NOT ", " OR ")):
        raise AssertionError("a filter did not reach the scan")
    return rows.select("p_partkey")
