"""The input tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import workers_find_package

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Lazy access: `t.lineitem`, `t["lineitem"]`, `t.sql("... FROM lineitem ...")`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        workers_find_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in NAMES:
            raise AttributeError(name)
        return self[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables it names, as temporary views."""
        for name in NAMES:
            if name in text:
                self[name].createOrReplaceTempView(name)
        return self.spark.sql(text)
