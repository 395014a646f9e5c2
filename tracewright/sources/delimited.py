"""Tables of delimited text in the catalogue, partitioned by columns.

A row is a line, fields end with the byte 1 and elements of arrays with the byte 2, a null is
a backslash and N.  Line ends, delimiters and backslashes inside values are written as
a backslash and a letter, so files are split at line ends anywhere, without quotes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from .tables import Tables

FIELD, ELEMENT, NULL, NULL_ELEMENT, EMPTY, NO_ELEMENTS = "\x01", "\x02", "\\N", "\\u", "\\0", "\\a"
# fixed values: what stands for a byte that cannot stand for itself; the backslash comes first
ESCAPES = [("\\", "\\e"), ("\n", "\\n"), ("\r", "\\r"), (FIELD, "\\f"), (ELEMENT, "\\g")]
OPTIONS = {"sep": FIELD, "nullValue": NULL, "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _escaped(c: Column) -> Column:
    c = c.cast("string")
    whole = c
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return F.when(whole == "", EMPTY).otherwise(c)


def _unescaped(c: Column, kind: T.DataType) -> Column:
    whole = c
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return F.when(whole == EMPTY, "").otherwise(c).cast(kind)


def encoded(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, _PLAIN):
        elements = F.array_join(F.transform(c, lambda x: F.coalesce(_escaped(x), F.lit(NULL_ELEMENT))), ELEMENT)
        return F.when(F.size(c) == 0, NO_ELEMENTS).when(c.isNotNull(), elements)
    if isinstance(kind, _PLAIN):
        return _escaped(c)
    raise ValueError(f"a delimited table holds no {kind.simpleString()}")


def decoded(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        elements = F.transform(F.split(c, ELEMENT, -1), lambda x: F.when(x != NULL_ELEMENT, _unescaped(x, kind.elementType)))
        return F.when(c == NO_ELEMENTS, F.array().cast(kind)).otherwise(elements)
    return _unescaped(c, kind)


@dataclass(frozen=True)
class DelimitedTable:
    """A table of the catalogue with the columns of `schema`, the last ones its partitions'.

    Partition columns hold plain values; null is a partition of its own.  Arrays hold plain
    values.  Reads prune
    partitions and columns; filters on data columns run after the lines are read.
    """

    spark: SparkSession
    name: str
    schema: T.StructType
    partition_by: tuple[str, ...] = ()

    @staticmethod
    def create_as(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DelimitedTable:
        """CREATE TABLE AS SELECT; an existing table of that name is an error."""
        data = [f for f in df.schema if f.name not in partition_by]
        table = DelimitedTable(df.sparkSession, name, T.StructType([*data, *[df.schema[p] for p in partition_by]]), partition_by)
        writer = table._written(df).write.format("csv").options(**OPTIONS)
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        return table

    def _written(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name) if f.name in self.partition_by else encoded(F.col(f.name), f.dataType).alias(f.name) for f in self.schema])

    def insert(self, df: DataFrame, overwrite: bool = False) -> None:
        """Adds rows; `overwrite` replaces the partitions (without any: the table) that the rows fall into."""
        key = "spark.sql.sources.partitionOverwriteMode"  # insertInto takes it from the session alone
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            self._written(df).write.insertInto(self.name, overwrite=overwrite)
        finally:
            self.spark.conf.set(key, before)

    def read(self) -> DataFrame:
        rows = self.spark.table(self.name)
        return rows.select(*[F.col(f.name) if f.name in self.partition_by else decoded(F.col(f.name), f.dataType).alias(f.name) for f in self.schema])

    def partitions(self) -> DataFrame:
        return self.spark.sql(f"SHOW PARTITIONS {self.name}")

    def recover(self) -> None:
        """Takes up partitions whose folders were written past the catalogue."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


_TYPED = "SELECT o_orderkey, o_custkey, {price} AS price, o_orderdate, CASE WHEN o_orderkey % 5 > 0 THEN {words} END AS words, o_orderstatus FROM orders"


@query("source_delimited_table", _TYPED.format(price="CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END", words="string_split(o_orderpriority, '-')") + " WHERE o_orderstatus <> 'P'")
def source_delimited_table(t: Tables) -> DataFrame:
    """Orders by their state as delimited text: made by a query, one partition replaced, two of them read."""
    orders = t.sql(_TYPED.format(price="o_totalprice", words="split(o_orderpriority, '-')"))
    table = DelimitedTable.create_as(orders, f"tw_orders_{uuid.uuid4().hex[:12]}", ("o_orderstatus",))
    table.insert(orders.where("o_orderstatus = 'F'").withColumn("price", F.lit(0.0)), overwrite=True)
    return table.read().where("o_orderstatus IN ('F', 'O')")


@query("cmd_show_partitions", "SELECT 'o_orderstatus=' || o_orderstatus AS partition, count(*) AS n FROM orders GROUP BY 1")
def cmd_show_partitions(t: Tables) -> DataFrame:
    """The partitions of a table made by a query, and the rows that each of them holds."""
    table = DelimitedTable.create_as(t.orders.select("o_orderkey", "o_orderstatus"), f"tw_orders_{uuid.uuid4().hex[:12]}", ("o_orderstatus",))
    counts = table.read().groupBy(F.concat(F.lit("o_orderstatus="), "o_orderstatus").alias("partition")).agg(F.count("*").alias("n"))
    return table.partitions().join(counts, "partition", "left")
