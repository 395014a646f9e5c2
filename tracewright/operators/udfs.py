"""User-defined functions of every kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables


@query("udf_pandas_scalar", "SELECT p_partkey, length(p_name)::BIGINT + p_size AS score FROM part")
def udf_pandas_scalar(t: Tables) -> DataFrame:
    @F.pandas_udf("long")
    def score(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str.len() + size

    return t.part.select("p_partkey", score("p_name", "p_size").alias("score"))


@query("udf_pandas_iterator", "SELECT p_partkey, p_size * 3 AS tripled FROM part")
def udf_pandas_iterator(t: Tables) -> DataFrame:
    @F.pandas_udf("int")
    def triple(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p * 3

    return t.part.select("p_partkey", triple("p_size").alias("tripled"))


@query("udf_arrow_row", "SELECT n_nationkey, reverse(n_name) AS mirrored FROM nation")
def udf_arrow_row(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.udf(lambda s: s[::-1], "string", useArrow=True)("n_name").alias("mirrored"))


@query("udf_registered_sql", "SELECT n_name, length(n_name)::INT * 2 AS twice FROM nation")
def udf_registered_sql(t: Tables) -> DataFrame:
    @F.pandas_udf("int")
    def twice_length(s: pd.Series) -> pd.Series:
        return s.str.len() * 2

    t.spark.udf.register("tw_twice_length", twice_length)
    return t.sql("SELECT n_name, tw_twice_length(n_name) AS twice FROM nation")


@query("udf_sql_macro", "SELECT n_nationkey, n_nationkey * 10 + n_regionkey AS code FROM nation")
def udf_sql_macro(t: Tables) -> DataFrame:
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tw_code(a INT, b INT) RETURNS INT RETURN a * 10 + b")
    return t.sql("SELECT n_nationkey, tw_code(n_nationkey, n_regionkey) AS code FROM nation")


@query("udtf_lateral", "SELECT n_nationkey, i::INT AS i FROM nation, range(0, 3) r(i) WHERE i < n_regionkey")
def udtf_lateral(t: Tables) -> DataFrame:
    @F.udtf(returnType="i int")
    class CountTo:
        def eval(self, n: int):
            for i in range(min(n, 3)):
                yield (i,)

    t.spark.udtf.register("tw_count_to", CountTo)
    return t.sql("SELECT n_nationkey, i FROM nation, LATERAL tw_count_to(n_regionkey)")


@query("udf_typed_filter", "SELECT n_name FROM nation WHERE length(n_name) % 2 = 0")
def udf_typed_filter(t: Tables) -> DataFrame:
    @F.pandas_udf("boolean")
    def even(s: pd.Series) -> pd.Series:
        return s.str.len() % 2 == 0

    return t.nation.where(even("n_name")).select("n_name")


@query("udf_map_groups", "SELECT c_nationkey AS k, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey")
def udf_map_groups(t: Tables) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [g.c_nationkey.iloc[0]], "n": [len(g)], "top": [g.c_acctbal.max()]})

    return t.customer.select("c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(run, "k int, n long, top double")


@query("udf_flat_map_groups", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 2")
def udf_flat_map_groups(t: Tables) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return g.sort_values(["c_acctbal", "c_custkey"], ascending=[False, True]).head(2)[["c_nationkey", "c_custkey"]]

    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(run, "c_nationkey int, c_custkey long")


@query("udf_map_in_pandas", "SELECT event_id, value * 2 AS v FROM events WHERE value > 50")
def udf_map_in_pandas(t: Tables) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[p.value > 50]
            yield pd.DataFrame({"event_id": p.event_id, "v": p.value * 2})

    return t.events.select("event_id", "value").mapInPandas(run, "event_id long, v double")


@query("udf_user_defined_type", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0")
def udf_user_defined_type(t: Tables) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t.customer.select(array_to_vector(F.array(F.col("c_acctbal"), F.lit(1.0))).alias("v"))  # a column of a user-defined type
    return rows.where(vector_to_array("v")[0] > 0).agg(F.count("*").alias("n"))
