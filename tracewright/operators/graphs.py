"""Graph algorithms as iterated joins over vertex and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import reliable
from ..registry import query
from ..sources.tables import Tables


class NotConverged(RuntimeError):
    """A stated number of rounds was not enough."""


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *[c for c in edges.columns if c not in ("src", "dst")]))


def pregel(vertices: DataFrame, edges: DataFrame, send: Callable[[DataFrame], DataFrame], merge, update, most: int | None = None, both_ways: bool = False) -> DataFrame:
    """Vertex states (id, state) under message passing until no vertex changes.

    `send` maps triplets (src, dst, attr.., state) to messages (id, message); only
    vertices that changed in the round before are sources of triplets.  `merge`
    aggregates `message`; `update` gives the new state from `state` and `message`
    of a vertex that a message reached.  There is no bound on the rounds unless
    `most` states one; states that still change then raise `NotConverged`.
    """
    edges = reliable(both_directions(edges) if both_ways else edges)
    states = reliable(vertices.select("id", "state"))
    active, turn = states, 0
    while True:
        triplets = edges.join(active.select("id", "state"), edges.src == active.id).drop("id")
        messages = send(triplets).groupBy("id").agg(merge.alias("message")).withColumn("reached", F.lit(True))
        new = F.when(F.col("reached"), update).otherwise(F.col("state"))
        moved = reliable(states.join(messages, "id", "left").select("id", "state", new.alias("new")))
        active = moved.where(~F.col("state").eqNullSafe(F.col("new"))).select("id", F.col("new").alias("state"))
        states = moved.select("id", F.col("new").alias("state"))
        if active.isEmpty():
            return states
        turn += 1
        if most is not None and turn >= most:
            raise NotConverged(f"states still change after {most} rounds")


def connected_components(vertices: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Smallest reachable id of every vertex, ignoring directions.

    Every vertex points to a smaller one of its component.  In a round a vertex and the one
    it points to take the smallest grandparent among the vertex's neighbours, then pointers
    are doubled, so the rounds grow with the logarithm of a component's diameter.
    """
    ways = reliable(both_directions(edges.select("src", "dst").where("src <> dst")))
    points = reliable(vertices.select("id", F.col("id").alias("state")))
    turn = 0
    while True:
        up = points.select(F.col("id").alias("state"), F.col("state").alias("top"))
        grand = reliable(points.join(up, "state").select("id", "state", "top"))
        seen = ways.join(grand.select(F.col("id").alias("dst"), F.col("top").alias("low")), "dst")
        low = seen.groupBy(F.col("src").alias("id")).agg(F.min("low").alias("low"))
        low = grand.join(low, "id").where("low < top")
        hooks = low.select("id", "low").unionByName(low.select(F.col("state").alias("id"), "low")).unionByName(low.select(F.col("top").alias("id"), "low"))
        hooks = hooks.groupBy("id").agg(F.min("low").alias("low"))
        moved = reliable(grand.join(hooks, "id", "left").select("id", "state", F.least("top", "low").alias("new")))
        points = moved.select("id", F.col("new").alias("state"))
        if moved.where("state <> new").isEmpty():
            return points
        turn += 1
        if most is not None and turn >= most:
            raise NotConverged(f"components still merge after {most} rounds")


def shortest_paths(vertices: DataFrame, edges: DataFrame, landmark) -> DataFrame:
    """Fewest hops to the vertices where `landmark` holds, against the edges; null if out of reach."""
    start = vertices.select("id", F.when(landmark, F.lit(0)).alias("state"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pregel(start, back, lambda x: x.where("state is not null").select(F.col("dst").alias("id"), (F.col("state") + 1).alias("message")), F.min("message"), F.least("state", "message"))


def page_rank(vertices: DataFrame, edges: DataFrame, rounds: int = 10, reset: float = 0.15, source: int | None = None) -> DataFrame:
    """Unnormalised ranks after a fixed number of rounds; with `source` all resets lead there."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = reliable(edges.join(degree, "src"))
    base = F.lit(reset) if source is None else F.when(F.col("id") == source, F.lit(reset)).otherwise(0.0)
    ranks = vertices.select("id", (F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)).alias("rank"))
    for i in range(rounds):
        given = links.join(ranks, links.src == ranks.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        ranks = vertices.select("id").join(given, F.col("id") == F.col("dst"), "left").select("id", (base + (1 - reset) * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            ranks = reliable(ranks)
    return ranks


def triangle_count(edges: DataFrame) -> DataFrame:
    """Triangles through each vertex; edges are made canonical, and wedges start at the end of lower degree."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = pairs.join(ends.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(ends.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = reliable(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closing = out.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    found = wedges.join(closing, ["v", "w"])
    return found.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Each vertex takes the most frequent label among its neighbours, the smallest of equals."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = reliable(vertices.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = ways.join(labels, ways.src == labels.id).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("m")).select(F.col("dst").alias("id"), (-F.col("m.minus")).alias("new"))
        labels = reliable(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Forward colouring by the smallest id, then a backward walk inside each colour from its root; repeated on the rest."""
    left, kept = reliable(vertices.select("id")), edges.select("src", "dst").where("src <> dst")
    out: DataFrame | None = None
    while not left.isEmpty():
        colours = pregel(left.select("id", F.col("id").alias("state")), kept, lambda x: x.select(F.col("dst").alias("id"), F.col("state").alias("message")), F.min("message"), F.least("state", "message"))
        inside = kept.join(colours.select(F.col("id").alias("src"), F.col("state").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("state").alias("b")), "dst").where("a = b").select("src", "dst")
        start = colours.select("id", F.when(F.col("id") == F.col("state"), F.col("state")).alias("state"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reach = pregel(start, back, lambda x: x.where("state is not null").select(F.col("dst").alias("id"), F.col("state").alias("message")), F.min("message"), F.coalesce("state", "message"))
        done = reliable(reach.where("state is not null").select("id", F.col("state").alias("component")))
        out = done if out is None else reliable(out.unionByName(done))
        left = reliable(left.join(done, "id", "left_anti"))
        kept = reliable(kept.join(left.select(F.col("id").alias("src")), "src").join(left.select(F.col("id").alias("dst")), "dst").select("src", "dst"))
    return out


def trade(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations that buy from nations: customers' nations to suppliers' nations with half as many lines again as the mean pair."""
    flows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = flows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    pairs = reliable(pairs)
    edges = pairs.join(F.broadcast(pairs.agg(F.avg("n").alias("mean"))), F.col("n") > 1.5 * F.col("mean"))  # one row
    return t.nation.select(F.col("n_nationkey").alias("id")), reliable(edges.select("src", "dst"))


_PAIRS = "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"
_EDGES = f"SELECT src, dst FROM (SELECT *, avg(n) OVER () AS mean FROM ({_PAIRS})) WHERE n > 1.5 * mean"
_WAYS = f"e AS ({_EDGES}), w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("graph_degrees", f"WITH {_WAYS} SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE src = n_nationkey) AS out_degree, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS in_degree FROM nation")
def graph_degrees(t: Tables) -> DataFrame:
    v, e = trade(t)
    out, into = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return v.join(out, "id", "left").join(into, "id", "left").na.fill(0)


@query("graph_connected_components", f"WITH RECURSIVE {_WAYS}, r AS (SELECT n_nationkey AS id, n_nationkey AS seen FROM nation UNION SELECT r.id, w.dst FROM r JOIN w ON w.src = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id")
def graph_connected_components(t: Tables) -> DataFrame:
    return connected_components(*trade(t)).withColumnRenamed("state", "component")


@query("graph_strong_components", f"WITH RECURSIVE {_WAYS}, r AS (SELECT n_nationkey AS id, n_nationkey AS seen FROM nation UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.seen) SELECT a.id, min(a.seen) AS component FROM r a JOIN r b ON a.id = b.seen AND a.seen = b.id GROUP BY a.id")
def graph_strong_components(t: Tables) -> DataFrame:
    return strong_components(*trade(t))


@query("graph_shortest_paths", f"WITH RECURSIVE {_WAYS}, p AS (SELECT 0 AS id, 0 AS d UNION SELECT e.src, p.d + 1 FROM p JOIN e ON e.dst = p.id WHERE p.d < 30) SELECT n_nationkey AS id, (SELECT min(d) FROM p WHERE p.id = n_nationkey) AS hops FROM nation")
def graph_shortest_paths(t: Tables) -> DataFrame:
    v, e = trade(t)
    return shortest_paths(v, e, F.col("id") == 0).withColumnRenamed("state", "hops")


@query("graph_triangles", f"WITH {_WAYS}, p AS (SELECT src AS a, dst AS b FROM w WHERE src < dst), t AS (SELECT x.a AS u, x.b AS v, y.b AS z FROM p x JOIN p y ON x.b = y.a JOIN p q ON q.a = x.a AND q.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT unnest([u, v, z]) AS id FROM t) GROUP BY id")
def graph_triangles(t: Tables) -> DataFrame:
    return triangle_count(trade(t)[1])


def _rank_sql(rounds: int, start: str, base: str) -> str:
    steps = [f"r0 AS (SELECT n_nationkey AS id, {start} AS rank FROM nation)"]
    steps += [f"r{i} AS (SELECT n_nationkey AS id, {base} + 0.85 * coalesce((SELECT sum(r.rank / d.n) FROM e JOIN r{i - 1} r ON r.id = e.src JOIN d ON d.src = e.src WHERE e.dst = n_nationkey), 0) AS rank FROM nation)" for i in range(1, rounds + 1)]
    return f"WITH {_WAYS}, d AS (SELECT src, count(*) AS n FROM e GROUP BY src), {', '.join(steps)} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query("graph_page_rank", _rank_sql(4, "1.0::DOUBLE", "0.15::DOUBLE"))
def graph_page_rank(t: Tables) -> DataFrame:
    return page_rank(*trade(t), rounds=4).select("id", F.round("rank", 8).alias("rank"))


@query("graph_page_rank_personal", _rank_sql(4, "CASE n_nationkey WHEN 3 THEN 1.0::DOUBLE ELSE 0 END", "CASE n_nationkey WHEN 3 THEN 0.15::DOUBLE ELSE 0 END"))
def graph_page_rank_personal(t: Tables) -> DataFrame:
    return page_rank(*trade(t), rounds=4, source=3).select("id", F.round("rank", 8).alias("rank"))


@query("graph_label_propagation", f"""WITH {_WAYS}, m AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT n_nationkey AS id, n_nationkey AS label FROM nation),
v1 AS (SELECT dst AS id, label, count(*) AS n FROM m JOIN l0 ON l0.id = m.src GROUP BY 1, 2), l1 AS (SELECT l0.id, coalesce((SELECT label FROM v1 WHERE v1.id = l0.id ORDER BY n DESC, label LIMIT 1), l0.label) AS label FROM l0),
v2 AS (SELECT dst AS id, label, count(*) AS n FROM m JOIN l1 ON l1.id = m.src GROUP BY 1, 2) SELECT l1.id, coalesce((SELECT label FROM v2 WHERE v2.id = l1.id ORDER BY n DESC, label LIMIT 1), l1.label) AS label FROM l1""")
def graph_label_propagation(t: Tables) -> DataFrame:
    return label_propagation(*trade(t), rounds=2)


@query("graph_aggregate_messages", f"WITH {_WAYS} SELECT id, sum(m)::BIGINT AS total FROM (SELECT dst AS id, src AS m FROM e UNION ALL SELECT src, dst FROM e) GROUP BY id")
def graph_aggregate_messages(t: Tables) -> DataFrame:
    e = trade(t)[1]
    return e.select(F.col("dst").alias("id"), F.col("src").alias("m")).unionByName(e.select(F.col("src").alias("id"), F.col("dst").alias("m"))).groupBy("id").agg(F.sum("m").alias("total"))


@query("graph_subgraph_neighbours", f"WITH {_WAYS} SELECT src AS id, list_sort(list(DISTINCT dst)) AS neighbours FROM w WHERE src < 15 AND dst < 15 GROUP BY src")
def graph_subgraph_neighbours(t: Tables) -> DataFrame:
    e = trade(t)[1].where("src < 15 AND dst < 15")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


@query("graph_vertex_set_ops", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def graph_vertex_set_ops(t: Tables) -> DataFrame:
    return t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id")).join(t.supplier.where("s_acctbal > 9000"), F.col("id") == F.col("s_nationkey"), "left_anti")
