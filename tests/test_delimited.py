"""Delimited tables: values round trip, partitions are pruned, replaced and recovered."""

import datetime
import uuid
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.sources.delimited import DelimitedTable

ODD = ["", " a ", "\\N", "\\", "\\n", "\\en", "\\0", "\\a", "a\nb", "\r\n", "\x01", "\x02x\x01", '"q"', "#c", "ü\u2028", None]


def name():
    return f"tw_test_{uuid.uuid4().hex[:12]}"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_odd_values(spark):
    rows = [(i, s, [s, None, "x"], None if i % 2 else i / 3, Decimal("1.50"), datetime.datetime(2024, 2, 29, 1, 2, 3, 4), i % 2 == 0) for i, s in enumerate(ODD)] + [(99, "z", [], None, None, None, None), (100, None, None, None, None, None, None), (101, "\\u", [None], None, None, None, None), (102, "", ["\\u", ""], None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, a array<string>, f double, d decimal(9, 2), at timestamp, b boolean")
    table = DelimitedTable.create_as(df, name())
    assert table.read().schema.simpleString() == df.schema.simpleString()
    assert rows_of(table.read()) == rows_of(df)
    table.drop()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from('\\Nnefgau0\x01\x02\n\r"\' ,x')), min_size=1, max_size=200))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(i, s, [s, s + "x"]) for i, s in enumerate(texts)], "k int, s string, a array<string>")
    table = DelimitedTable.create_as(df, name())
    assert rows_of(table.read()) == rows_of(df)
    table.drop()


def test_partitions(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("p/"), F.col("id") % 4)).alias("part"))
    table = DelimitedTable.create_as(df, name(), ("part",))
    assert rows_of(table.read()) == rows_of(df) and table.partitions().count() == 4
    some = table.read().where("part = 'p/1'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert some.count() == 10 and len(some.inputFiles()) < len(table.read().inputFiles())
    table.insert(df.where("part = 'p/1'").withColumn("id", F.col("id") + 100), overwrite=True)
    assert table.read().where("part = 'p/1' AND id < 100").count() == 0 and table.read().count() == 40
    table.insert(df.where("part IS NULL"))
    assert table.read().where("part IS NULL").count() == 20
    table.drop()


def test_folders_written_past_the_catalogue(spark):
    df = spark.createDataFrame([("a", 1)], "v string, p int")
    table = DelimitedTable.create_as(df, name(), ("p",))
    place = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table.name}").collect()}["Location"]
    spark.createDataFrame([("b",)], "v string").write.text(f"{place}/p=2")
    table.recover()
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([("a", 1), ("b", 2)], "v string, p int"))
    table.drop()


def test_refused_columns(spark):
    with pytest.raises(ValueError):
        DelimitedTable.create_as(spark.sql("SELECT map(1, 2) AS m"), name())
