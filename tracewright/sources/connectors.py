"""File sources and sinks: each query writes a table in a format and reads it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch
from ..registry import query
from .database import embedded
from .tables import Tables


def folder(t: Tables, name: str) -> str:
    """A fresh path in the shared folder of the cluster."""
    return scratch(t.spark, name)


_PART = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


def _part(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def _round_trip(name: str, write: Callable[[DataFrame, str], None], read: Callable[[Tables, str, DataFrame], DataFrame]) -> None:
    def run(t: Tables) -> DataFrame:
        path, rows = folder(t, name), _part(t)
        write(rows, path)
        return read(t, path, rows)

    query(f"source_{name}", _PART)(run)


_round_trip("parquet", lambda d, p: d.write.parquet(p), lambda t, p, d: t.spark.read.parquet(p))
_round_trip("orc", lambda d, p: d.write.orc(p), lambda t, p, d: t.spark.read.orc(p))
_round_trip("json", lambda d, p: d.write.json(p), lambda t, p, d: t.spark.read.schema(d.schema).json(p))
_round_trip("json_inferred", lambda d, p: d.write.json(p), lambda t, p, d: t.spark.read.json(p).select(*d.columns).withColumn("p_size", F.col("p_size").cast("int")))
_round_trip("csv", lambda d, p: d.write.option("header", True).option("sep", ";").csv(p), lambda t, p, d: t.spark.read.schema(d.schema).option("header", True).option("sep", ";").csv(p))
_round_trip("text", lambda d, p: d.select(F.to_json(F.struct("*")).alias("value")).write.text(p), lambda t, p, d: t.spark.read.text(p).select(F.from_json("value", d.schema).alias("r")).select("r.*"))
_round_trip("partitioned", lambda d, p: d.write.partitionBy("p_brand").parquet(p), lambda t, p, d: t.spark.read.parquet(p).select(*d.columns))
_round_trip("xml", lambda d, p: d.write.option("rowTag", "part").xml(p), lambda t, p, d: t.spark.read.schema(d.schema).option("rowTag", "part").xml(p))


@query("source_merge_schema", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS p_brand FROM part")
def source_merge_schema(t: Tables) -> DataFrame:
    path = folder(t, "merge")
    t.part.where("p_partkey % 2 = 0").select("p_partkey", "p_size").write.parquet(f"{path}/half=0")
    t.part.where("p_partkey % 2 = 1").select("p_partkey", "p_brand").write.parquet(f"{path}/half=1")
    return t.spark.read.option("mergeSchema", True).parquet(path).select("p_partkey", "p_size", "p_brand")


@query("source_partition_pruning", "SELECT p_partkey FROM part WHERE p_size = 7")
def source_partition_pruning(t: Tables) -> DataFrame:
    path = folder(t, "pruned")
    t.part.select("p_partkey", "p_size").repartition("p_size").write.partitionBy("p_size").parquet(path)
    return t.spark.read.parquet(path).where("p_size = 7").select("p_partkey")


@query("source_save_modes", "SELECT 50 AS appended, 25 AS overwritten, 25 AS ignored, true AS refused")
def source_save_modes(t: Tables) -> DataFrame:
    path, d = folder(t, "modes"), t.nation
    count = lambda: t.spark.read.parquet(path).count()
    d.write.parquet(path)
    d.write.mode("append").parquet(path)
    appended = count()
    d.write.mode("overwrite").parquet(path)
    overwritten = count()
    d.write.mode("ignore").parquet(path)
    ignored = count()
    try:
        d.write.mode("error").parquet(path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return t.spark.createDataFrame([(appended, overwritten, ignored, refused)], "appended int, overwritten int, ignored int, refused boolean")


@query("source_csv_modes", "SELECT count(*) AS permissive, count(*) FILTER (o_orderkey % 5 > 0) AS keys, count(*) FILTER (o_orderkey % 5 > 0) AS dropped, true AS failed FROM orders")
def source_csv_modes(t: Tables) -> DataFrame:
    """Every fifth order's key is no number: kept as a null, dropped, or the end of the job."""
    path = folder(t, "malformed")
    key = F.expr("if(o_orderkey % 5 = 0, 'x', CAST(o_orderkey AS STRING))")
    t.orders.select(F.concat_ws(",", key, "o_orderstatus").alias("value")).write.text(path)
    read = t.spark.read.schema("k BIGINT, v STRING")
    kept = read.option("mode", "PERMISSIVE").csv(path).agg(F.count("v").alias("permissive"), F.count("k").alias("keys"))
    dropped = read.option("mode", "DROPMALFORMED").csv(path).where("v IS NOT NULL OR k IS NULL").agg(F.count("k").alias("dropped"))
    try:
        read.option("mode", "FAILFAST").csv(path).agg(F.count("k"), F.count("v")).collect()
        failed = False
    except Exception:
        failed = True
    return kept.join(dropped).withColumn("failed", F.lit(failed))


@query("source_whole_text", "SELECT 25 AS lines, 1 AS files")
def source_whole_text(t: Tables) -> DataFrame:
    path = folder(t, "whole")
    t.nation.select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    whole = t.spark.read.text(path, wholetext=True)
    return whole.agg(F.sum(F.size(F.split(F.rtrim(F.regexp_replace("value", r"\n$", "")), "\n"))).cast("int").alias("lines"), F.count("*").cast("int").alias("files"))


@query("source_binary_files", "SELECT true AS sized, 1 AS files")
def source_binary_files(t: Tables) -> DataFrame:
    path = folder(t, "binary")
    t.nation.select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.agg((F.min("length") == F.min(F.length("content"))).alias("sized"), F.count("*").cast("int").alias("files"))


@query("source_libsvm", "SELECT p_partkey::DOUBLE AS label, p_size::DOUBLE AS size FROM part")
def source_libsvm(t: Tables) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    path = folder(t, "libsvm")
    t.part.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.concat(F.lit("1:"), F.col("p_size").cast("string"))).alias("value")).write.text(path)
    return t.spark.read.format("libsvm").option("numFeatures", 1).load(path).select("label", vector_to_array("features")[0].alias("size"))


@query("source_sequence_file", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def source_sequence_file(t: Tables) -> DataFrame:
    """Hadoop sequence files exist only in the RDD API."""
    path, sc = folder(t, "sequence"), t.spark.sparkContext
    t.nation.select("n_nationkey", "n_name").rdd.map(tuple).saveAsSequenceFile(path)
    return t.spark.createDataFrame(sc.sequenceFile(path), "k int, v string")


@query("source_cached_scan", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 5 GROUP BY n_regionkey")
def source_cached_scan(t: Tables) -> DataFrame:
    from pyspark import StorageLevel

    return t.nation.persist(StorageLevel.MEMORY_AND_DISK).where("n_nationkey > 5").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("source_local_rows", "SELECT k, v, count(*) AS n FROM (VALUES ('F', 'filled'), ('O', NULL)) x(k, v) JOIN orders ON o_orderstatus = k GROUP BY k, v")
def source_local_rows(t: Tables) -> DataFrame:
    """Two rows of the driver name the states of all orders."""
    names = t.spark.createDataFrame([("F", "filled"), ("O", None)], "k string, v string")
    return t.orders.join(F.broadcast(names), F.col("o_orderstatus") == F.col("k")).groupBy("k", "v").agg(F.count("*").alias("n"))


def read_jdbc(t: Tables, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ranges of a column; needs the database's driver on the class path."""
    return t.spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def read_kafka(t: Tables, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """A Kafka topic; needs the connector package on the class path."""
    reader = t.spark.readStream if streaming else t.spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


@query("source_jdbc", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_jdbc(t: Tables) -> DataFrame:
    """A table written to and read from a database in ranges of its key; the embedded database comes with Spark."""
    db = embedded(t.spark)
    db.append_once(t.nation, "nation", "load")
    rows = t.spark.read.jdbc(db.open_url(), db.dialect.quote("nation"), column="n_nationkey", lowerBound=0, upperBound=25, numPartitions=2, properties=db.options)
    return rows.toDF(*[c.lower() for c in rows.columns])


@query("source_jdbc_predicates", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def source_jdbc_predicates(t: Tables) -> DataFrame:
    """One partition per predicate."""
    db = embedded(t.spark)
    db.append_once(t.nation, "nation", "load")
    rows = t.spark.read.jdbc(db.open_url(), db.dialect.quote("nation"), predicates=['"n_regionkey" = 1', '"n_regionkey" = 3'], properties=db.options)
    return rows.toDF(*[c.lower() for c in rows.columns]).select("n_name")
