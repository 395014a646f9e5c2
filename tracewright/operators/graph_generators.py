"""Synthetic graphs over the keys of a table: grid, star, log-normal degrees, recursive matrices.

Random choices are a function of (key, salt), so a task that is run again makes the same
edges and SQL can state them; the edges are made where the keys are, without a shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables

_P = 2147483647


def uniform(key: str, salt: str | int) -> str:
    """An SQL expression in (0, 1) that depends on a key (an integer from 0) and a salt alone."""
    mixed = f"((({key}) % {_P}) * 48271 + ({salt}) * 69621 + 12345) % {_P}"
    squared = f"(({mixed}) * ({mixed}) + 16807) % {_P}"
    return f"((({squared}) * 39373 % {_P}) + 0.5D) / {_P}"


def grid(keys: DataFrame, key: str, side: int) -> DataFrame:
    """Vertices 0, 1, ... in rows of `side`; an edge to the next one in the row and in the column.

    The edges are those between vertices below the number of keys, which must be dense from 0.
    """
    k, n = F.col(key), keys.count()
    right = keys.where(((k + 1) % side != 0) & (k + 1 < n)).select(k.alias("src"), (k + 1).alias("dst"))
    return right.unionByName(keys.where(k + side < n).select(k.alias("src"), (k + side).alias("dst")))


def star(keys: DataFrame, key: str, centre: int = 0) -> DataFrame:
    """An edge from every other vertex to the centre."""
    return keys.where(F.col(key) != centre).select(F.col(key).alias("src"), F.lit(centre).cast("long").alias("dst"))


def normal(key: str, salt: int) -> str:
    """A standard normal number of a key, by the polar formula on two uniform ones."""
    return f"sqrt(-2 * ln({uniform(key, salt)})) * cos({2 * math.pi!r}D * {uniform(key, salt + 1)})"


def log_normal_degree(key: str, mu: float, sigma: float) -> str:
    return f"CAST(floor(exp({mu}D + {sigma}D * {normal(key, 1)})) AS BIGINT)"


def log_normal(keys: DataFrame, key: str, vertices: int, mu: float, sigma: float) -> DataFrame:
    """Edges whose numbers per source are log-normal, to vertices chosen evenly."""
    degrees = keys.selectExpr(f"{key} AS src", f"{log_normal_degree(key, mu, sigma)} AS degree").where("degree > 0")
    numbered = degrees.select("src", F.explode(F.sequence(F.lit(1).cast("long"), "degree")).alias("i"))
    return numbered.selectExpr("src", f"CAST(floor({uniform('src * 8191 + i', 3)} * {vertices}) AS BIGINT) AS dst")


def recursive_matrix_ends(key: str, levels: int, a: float, b: float, c: float) -> tuple[str, str]:
    """SQL expressions of both ends of edge `key`: at each level one quadrant of the matrix is chosen."""
    picks = [uniform(key, 10 + level) for level in range(levels)]
    src = " + ".join(f"CASE WHEN {u} >= {a + b}D THEN {1 << i} ELSE 0 END" for i, u in enumerate(picks))
    dst = " + ".join(f"CASE WHEN {u} >= {a + b + c}D OR ({u} >= {a}D AND {u} < {a + b}D) THEN {1 << i} ELSE 0 END" for i, u in enumerate(picks))
    return src, dst


def recursive_matrix(edges: DataFrame, key: str, levels: int, a: float = 0.45, b: float = 0.15, c: float = 0.15) -> DataFrame:
    """One edge per key among 2^levels vertices, with the degrees of a recursive matrix."""
    src, dst = recursive_matrix_ends(key, levels, a, b, c)
    return edges.selectExpr(f"CAST({src} AS BIGINT) AS src", f"CAST({dst} AS BIGINT) AS dst")


def _duck(expression: str) -> str:
    """The same expression in the oracle's dialect: no suffix marks a double."""
    return re.sub(r"(?<=\d)D\b", "::DOUBLE", expression)


_SIDE = "ceil(sqrt(count(*)))::BIGINT AS side, count(*) AS n"


@query(
    "graph_generators",
    f"SELECT (sum(((c_custkey + 1) % side <> 0 AND c_custkey + 1 < n)::INT) + sum((c_custkey + side < n)::INT))::BIGINT AS grid_edges, sum((c_custkey <> 0)::INT)::BIGINT AS star_edges FROM customer, (SELECT {_SIDE} FROM customer)",
)
def graph_generators(t: Tables) -> DataFrame:
    """A grid and a star of as many vertices as there are customers."""
    side = math.isqrt(max(t.customer.count() - 1, 0)) + 1
    edges = grid(t.customer, "c_custkey", side).withColumn("kind", F.lit("grid")).unionByName(star(t.customer, "c_custkey").withColumn("kind", F.lit("star")))
    return edges.agg(F.count_if(F.col("kind") == "grid").alias("grid_edges"), F.count_if(F.col("kind") == "star").alias("star_edges"))


@query(
    "graph_log_normal",
    f"SELECT degree, count(*) AS vertices FROM (SELECT {_duck(log_normal_degree('c_custkey', 1.0, 0.7))} AS degree FROM customer) WHERE degree > 0 GROUP BY 1",
)
def graph_log_normal(t: Tables) -> DataFrame:
    """Out-degrees of a generated graph over the customers."""
    edges = log_normal(t.customer, "c_custkey", t.customer.count(), 1.0, 0.7)
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


_RMAT = recursive_matrix_ends("o_orderkey", 6, 0.45, 0.15, 0.15)


@query("graph_recursive_matrix", f"SELECT src, count(*) AS edges, count(DISTINCT dst) AS partners FROM (SELECT ({_duck(_RMAT[0])})::BIGINT AS src, ({_duck(_RMAT[1])})::BIGINT AS dst FROM orders) GROUP BY 1")
def graph_recursive_matrix(t: Tables) -> DataFrame:
    """An edge per order among 64 vertices: few vertices hold most edges."""
    return recursive_matrix(t.orders, "o_orderkey", 6).groupBy("src").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("partners"))
