"""A Python data source that takes filters, prunes row groups and gives Arrow batches; and samples by bucket."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..registry import query
from ..session import workers_find_package
from .connectors import folder
from .tables import Tables

#: What a comparison says of a row group with these least and largest values, and of a column.
_COMPARED = {
    EqualTo: (lambda low, high, v: low <= v <= high, lambda c, v: c == v),
    GreaterThan: (lambda low, high, v: high > v, lambda c, v: c > v),
    GreaterThanOrEqual: (lambda low, high, v: high >= v, lambda c, v: c >= v),
    LessThan: (lambda low, high, v: low < v, lambda c, v: c < v),
    LessThanOrEqual: (lambda low, high, v: low <= v, lambda c, v: c <= v),
    In: (lambda low, high, v: any(low <= x <= high for x in v), lambda c, v: c.isin(list(v))),
}


class RowGroupSource(DataSource):
    """Options: path (a folder of Parquet files), columns (their names and types)."""

    @classmethod
    def name(cls) -> str:
        return "tw_row_groups"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return RowGroupReader(schema, self.options["path"])


class RowGroupReader(DataSourceReader):
    def __init__(self, schema, path: str):
        self.schema, self.path, self.taken = schema, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of a column with values; leaves the others to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            known = type(f) in _COMPARED and value is not None and not (isinstance(value, tuple) and None in value)
            if len(column) == 1 and (known or isinstance(f, IsNotNull)):
                self.taken.append((type(f), column[0], value))
            else:
                yield f

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")

    def _may_hold(self, group: pq.RowGroupMetaData, places: dict[str, int]) -> bool:
        for kind, column, value in self.taken:
            s = group.column(places[column]).statistics
            if kind in _COMPARED and s is not None and s.has_min_max and not _COMPARED[kind][0](s.min, s.max, value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """A partition per row group that the filters do not rule out."""
        system, at = self._system()
        out = []
        for f in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
            if f.base_name.endswith(".parquet"):
                with system.open_input_file(f.path) as handle:
                    known = pq.ParquetFile(handle).metadata
                places = {known.schema.column(i).name: i for i in range(known.num_columns)}
                out += [InputPartition((f.path, g)) for g in range(known.num_row_groups) if self._may_hold(known.row_group(g), places)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, group = partition.value
        target = to_arrow_schema(self.schema)
        system, _ = self._system()
        with system.open_input_file(path) as handle:
            table = pq.ParquetFile(handle).read_row_group(group, columns=target.names).select(target.names).cast(target)
        for kind, column, value in self.taken:
            c = pc.field(column)
            table = table.filter(_COMPARED[kind][1](c, value) if kind in _COMPARED else c.is_valid())
        yield from table.to_batches()


def row_groups(spark: SparkSession, path: str, columns: str) -> DataFrame:
    workers_find_package(spark)
    spark.dataSource.register(RowGroupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tw_row_groups").option("path", path).option("columns", columns).load()


PARTS = "p_partkey long, p_name string, p_size int, p_retailprice double"


def sorted_parts(t: Tables, files: int = 4) -> str:
    """Parts as files of ranges of their size."""
    path = folder(t, "parts")
    t.part.selectExpr("p_partkey", "p_name", "p_size", "p_retailprice").repartitionByRange(files, "p_size").sortWithinPartitions("p_size").write.parquet(path)
    return path


@query("source_python_format", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (3, 7) AND p_retailprice > 1000 AND length(p_name) > 3")
def source_python_format(t: Tables) -> DataFrame:
    """A source of our own that reads only the row groups and rows that its filters leave."""
    rows = row_groups(t.spark, sorted_parts(t), PARTS)
    return rows.where("p_size IN (3, 7) AND p_retailprice > 1000 AND length(p_name) > 3").select("p_partkey", "p_name", "p_size")


def bucket_sample(spark: SparkSession, table: str, number: int, out_of: int, column: str | None = None) -> DataFrame:
    """TABLESAMPLE (BUCKET number OUT OF out_of ON column): the rows whose key falls into one of so many buckets.

    Where the table is bucketed by that column into a multiple of `out_of` buckets, only the files of
    those buckets are read; any other table is filtered by the same hash.  The buckets together are
    the table, each row in one.
    """
    if not 1 <= number <= out_of:
        raise ValueError(f"bucket {number} out of {out_of}")
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    buckets, by = int(told.get("Num Buckets", "0")), re.findall(r"`([^`]*)`", told.get("Bucket Columns", ""))
    column = column or (by[0] if len(by) == 1 else None)
    if column is None:
        raise ValueError(f"{table} has no bucket column")
    rows = spark.table(table)
    if by != [column] or buckets % out_of:
        return rows.where(F.pmod(F.hash(column), F.lit(out_of)) == number - 1)
    files = [f for f in rows.inputFiles() if int(re.search(r"_(\d{5})(?:\.[^/]*)?$", f)[1]) % out_of == number - 1]
    return spark.read.schema(rows.schema).format(told["Provider"].lower()).load(files) if files else rows.where("false")


def bucketed_orders(t: Tables, buckets: int = 8) -> str:
    name = f"tw_orders_{uuid.uuid4().hex[:10]}"
    t.orders.write.bucketBy(buckets, "o_orderkey").format("parquet").saveAsTable(name)
    return name


@query("sample_table_buckets", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, 4 AS samples FROM orders")
def sample_table_buckets(t: Tables) -> DataFrame:
    """The four samples of a bucketed table are the table."""
    name = bucketed_orders(t)
    parts = [bucket_sample(t.spark, name, i, 4).select("o_orderkey", F.lit(i).alias("sample")) for i in (1, 2, 3, 4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.countDistinct("sample").cast("int").alias("samples"))


def measured_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most_bytes: int = 64 << 20, most_rows: int = 1_000_000) -> DataFrame:
    """A join whose right side is broadcast only if its measured rows and bytes are within the limits, and shuffled beyond them.

    The measure is one job over the right side: texts and binaries by their length, arrays by eight bytes an element, other values by eight.
    """
    sizes = [F.lit(8)]
    for name, kind in right.dtypes:
        sizes.append(F.octet_length(name) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith("array") else F.lit(8))
    total = sum((F.greatest(F.coalesce(s, F.lit(0)), F.lit(0)).cast("long") for s in sizes), F.lit(0).cast("long"))
    rows, held = right.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    small = rows <= most_rows and held <= most_bytes
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


@query("join_measured_broadcast", "SELECT n_name, count(*) AS customers, sum(c_custkey)::BIGINT AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_measured_broadcast(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return measured_join(t.customer, nations, ["c_nationkey"]).groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("c_custkey").alias("ids"))
