"""Graph loading, edge partitioning and ranking to a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import reliable
from ..registry import query
from ..sources.connectors import folder
from ..sources.tables import Tables
from .graphs import _EDGES, _WAYS, NotConverged, trade


def load_edges(spark, path: str, comment: str = "#") -> DataFrame:
    """(src, dst) from lines of two ids with white space between; lines that begin with `comment` are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))


@query("graph_edge_list", f"WITH {_WAYS} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e")
def graph_edge_list(t: Tables) -> DataFrame:
    path = folder(t, "edges")
    e = trade(t)[1]
    t.spark.createDataFrame([("# src dst",), ("",)], "value string").coalesce(1).write.text(path)
    e.select(F.concat_ws("\t  ", "src", "dst").alias("value")).write.mode("append").text(path)
    return load_edges(t.spark, path)


def by_source(n: int) -> Column:
    """All edges of a source in one part."""
    return F.pmod(F.xxhash64("src"), F.lit(n))


def by_both(n: int) -> Column:
    """Edges of one direction between two vertices in one part, any pair anywhere."""
    return F.pmod(F.xxhash64("src", "dst"), F.lit(n))


def by_pair(n: int) -> Column:
    """Both directions between two vertices in one part."""
    return F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(n))


def by_grid(n: int) -> Column:
    """A grid of parts: a vertex's edges lie in one row and one column, so in fewer than 2 sqrt(n) parts."""
    side = max(1, int(n**0.5))
    return F.pmod(F.xxhash64("src"), F.lit(side)) * side + F.pmod(F.xxhash64("dst", F.lit(1)), F.lit(side))


@query("graph_partition_strategies", f"WITH {_WAYS}, b AS (SELECT count(*) AS n FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst) SELECT count(*) AS edges, true AS source_in_one, (SELECT n FROM b) AS pairs_together, true AS grid_bound FROM e")
def graph_partition_strategies(t: Tables) -> DataFrame:
    return promises_kept(trade(t)[1])


def promises_kept(edges: DataFrame) -> DataFrame:
    """Whether each way to deal edges out keeps its promise; where there is no edge, none is broken."""
    n, yes = 9, F.lit(True)
    e = reliable(edges.withColumns({"s": by_source(n), "p": by_pair(n), "g": by_grid(n), "b": by_both(n)}))
    most = e.groupBy("src").agg(F.countDistinct("s").alias("k")).agg(F.coalesce(F.max("k") == 1, yes).alias("source_in_one"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    pairs = e.join(back, ["src", "dst"]).where("src < dst AND p = q").agg(F.count("*").alias("pairs_together"))
    ends = e.select(F.col("src").alias("v"), "g").unionByName(e.select(F.col("dst").alias("v"), "g")).groupBy("v").agg(F.countDistinct("g").alias("k"))
    return e.agg(F.count("*").alias("edges")).join(most).join(pairs).join(ends.agg(F.coalesce(F.max("k") < 2 * n**0.5, yes).alias("grid_bound")))  # one row each


def rank_to_tolerance(vertices: DataFrame, edges: DataFrame, tolerance: float, most: int = 100) -> tuple[DataFrame, int]:
    """PageRank until no rank changes by more than the tolerance: (id, rank) and the number of rounds.

    A rank's change shrinks by 0.85 a round, so `most` bounds no tolerance above 1e-7 of the largest
    rank; where it is not enough the call raises `NotConverged`.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    ranks = reliable(vertices.select("id", F.lit(1.0).alias("rank")))
    for turn in range(1, most + 1):
        sent = edges.join(ranks.join(out, "id").select(F.col("id").alias("src"), (F.col("rank") / F.col("n")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("all"))
        new = reliable(ranks.join(sent, "id", "left").select("id", F.col("rank").alias("old"), (0.15 + 0.85 * F.coalesce("all", F.lit(0.0))).alias("rank")))
        change = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = new.select("id", "rank")
        if change <= tolerance:
            return ranks, turn
    raise NotConverged(f"ranks still change by {change:g} after {most} rounds")


@query("graph_page_rank_to_tolerance", f"""WITH RECURSIVE d AS (SELECT src, count(*) AS n FROM ({_EDGES}) GROUP BY src), e AS (SELECT x.src, x.dst, d.n FROM ({_EDGES}) x JOIN d USING (src)),
r AS (SELECT 0 AS turn, map_from_entries(list((n_nationkey, 1.0::DOUBLE))) AS ranks FROM nation UNION ALL
SELECT turn + 1, (SELECT map_from_entries(list((n_nationkey, 0.15 + 0.85 * coalesce((SELECT sum(ranks[e.src] / e.n) FROM e WHERE e.dst = n_nationkey), 0)))) FROM nation) FROM r WHERE turn < 60)
SELECT key AS id, round(value, 4) AS rank FROM (SELECT unnest(map_entries(ranks), recursive := true) FROM r WHERE turn = 60)""")
def graph_page_rank_to_tolerance(t: Tables) -> DataFrame:
    ranks, _ = rank_to_tolerance(*trade(t), tolerance=1e-6)
    return ranks.select("id", F.round("rank", 4).alias("rank"))
