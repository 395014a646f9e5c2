"""Connected components and block-wise comparison of groups, on DataFrames.

Edges are first reduced to spanning stars inside each partition.  A remainder
of up to `ONE_TASK` edges is finished by one task; a larger one by alternating
large-star and small-star rounds, each a pair of aggregations and joins cut by a
checkpoint.  Nothing is collected to the driver but counts.

Groups are compared in blocks of bounded size.  A block is one packed row once
its own pairs are done, and only packed rows are repeated for the pairs of
blocks, so a large group costs rows by the square of its number of blocks, not
of its members, and no link is written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidy

ONE_TASK = 200_000
HUB = 10_000
HUBS = 100_000
SALTS = 32


def label_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the edges and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        best = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], best)
        np.minimum.at(new, low[y], best)
        np.minimum.at(new, x, best)
        np.minimum.at(new, y, best)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def matrix_components(near: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each row of a symmetric matrix of links."""
    n = len(near)
    low = np.arange(n)
    while True:
        best = np.minimum(low, np.where(near, low, n).min(1, initial=n))
        new = best.copy()
        np.minimum.at(new, low, best)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, low):
            return low
        low = new


def linked_labels(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a row's and a column's label that are linked."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[i], b[j]
    p, q = (np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in (a, b))
    some = np.logical_or.reduceat(np.logical_or.reduceat(near[i][:, j], p, axis=0), q, axis=1)
    x, y = np.nonzero(some)
    return a[p][x], b[q][y]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as edges to the smallest node of each component."""
    if not len(a):
        return a, b
    a, b = label_components(a, b)
    return a[a != b], b[a != b]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as edges to the smallest node of each local component."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []
    size = 0

    def fold() -> None:
        nonlocal a, b, held, size
        a, b = stars(np.concatenate([a, *[h.column(0).to_numpy() for h in held]]), np.concatenate([b, *[h.column(1).to_numpy() for h in held]]))
        held, size = [], 0

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 200_000:
            fold()
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def join_counted(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """`rows` joined with `table`, which has one row for each key and `n`, how many rows have it.

    Keys of very many rows go by a broadcast, which their number of rows bounds to
    `HUBS` keys; the others by a shuffle, in which no key is hot.  `n` goes.
    """
    hot = F.col("n") > max(HUB, total // HUBS)
    marked = [c for c in table.columns if c not in (*key, "n")]
    hubs = table.where(hot).select(*key, F.lit(True).alias("is_hub"), *[F.col(c).alias("hub_" + c) for c in marked])
    both = rows.join(F.broadcast(hubs), key, "left")
    done = both.where("is_hub").select(*rows.columns, *[F.col("hub_" + c).alias(c) for c in marked])
    rest = both.where("is_hub is null").select(*rows.columns)
    return done.unionByName(rest.join(table.where(~hot).drop("n"), key).select(*rows.columns, *marked))


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for all nodes of the edges (a long, b long; read several times); component is the smallest node."""
    e = edges.select("a", "b").where("a <> b")
    n = e.count()
    if n > one_task:
        # dealt out first, so that no task runs the Python of the edges and that of the stars side by side
        e = checkpointed(e.repartition("a").mapInArrow(tidy(_stars), "a long, b long"))
        n = e.count()
    if n <= one_task:
        found = e.repartition(1).mapInArrow(tidy(_stars), "a long, b long")
        return checkpointed(_with_roots(found))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, low, ["a"], 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, ["a"], 2 * n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # a node keeps its edge to its smallest neighbour even when that neighbour comes from several edges
        e = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return _with_roots(e)
        before, n = now, now[0]


def _with_roots(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def smallest_ids(nodes: DataFrame, parts: DataFrame, total: int) -> DataFrame:
    """(node, least): the smallest `least` of the component of each of the `nodes` (node, least); `parts` has (node, component)."""
    own = nodes.join(parts, "node").select("node", "component", "least")
    low = own.groupBy("component").agg(F.min("least").alias("low"), F.count("*").alias("n"))
    return join_counted(own.select("node", "component"), low, ["component"], total).select("node", F.col("low").alias("least"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows in runs of equal keys (longs or ints without nulls), from batches that are sorted by them."""
    held: list[pa.Table] = []

    def differs(a: pa.Table, b: pa.Table) -> bool:
        return any(a[k][a.num_rows - 1].as_py() != b[k][0].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        if held and differs(held[-1], t):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(cut[:-2], cut[1:-1], strict=True):
            yield pa.concat_tables([*held, t.slice(a, b - a)]).combine_chunks() if held else t.slice(a, b - a)
            held = []
        held.append(t.slice(cut[-2], cut[-1] - cut[-2]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


Compare = Callable[[pa.Table, pa.Table], np.ndarray]
FOUND = "component long, own int, blocks int, node long, n long, label long, data binary"


def _frame(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unframe(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _rows(component: list, own: list, blocks: list, node, n, label, data: list) -> pa.RecordBatch:
    columns = [pa.array(component, pa.int64()), pa.array(own, pa.int32()), pa.array(blocks, pa.int32()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(label, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["component", "own", "blocks", "node", "n", "label", "data"])


def dealt_in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Adds `blocks`, the number of blocks of the member's component, and `own`, the member's block.

    `load` of a member is its size in members of usual size (1 at least); the blocks
    of a component are dealt so that each holds a load of about `block`.  The sizes
    of large components meet their members in salted parts.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    large = members.groupBy("component").agg(F.sum("load").alias("all")).where(F.col("all") > block)
    large = large.select("component", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = members.withColumn("salt", salt).join(large, ["component", "salt"], "left").drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))


def inside_blocks(rows: DataFrame, compare: Compare, keep: bool) -> DataFrame:
    """Compares the members of each block: a row (node, n, label) for each member that another one is near.

    `rows` has component, own, blocks, node, copies and what `compare` reads.  `n`
    counts the copies of the near ones, `label` is the smallest node of the part of
    the block that links join.  With `keep`, the blocks of a component of several
    are also returned as packed rows (data not null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for t in grouped(batches, ["component", "own"]):
            node = t["node"].to_numpy()
            if (again := node[1:] == node[:-1]).any():  # rows that repeat a node count once
                t = t.filter(pa.array(np.append(True, ~again))).combine_chunks()
                node = t["node"].to_numpy()
            copies = t["copies"].to_numpy()
            near = compare(t, t) if len(node) > 1 else np.zeros((1, 1), bool)
            near |= near.T
            np.fill_diagonal(near, False)
            label, n = node[matrix_components(near)], near @ copies
            if keep and t["blocks"][0].as_py() > 1:
                packed = t.drop_columns(["component", "own", "blocks"]).append_column("n", pa.array(n)).append_column("label", pa.array(label))
                yield _rows([t["component"][0].as_py()], [t["own"][0].as_py()], [t["blocks"][0].as_py()], [None], [None], [None], [_frame(packed)])
            elif near.any():
                held.append((node[n > 0], n[n > 0], label[n > 0]))
                size += len(held[-1][0])
            if size > 5000:
                yield _results(held)
                held, size = [], 0
        yield _results(held)

    return rows.repartition("component", "own").sortWithinPartitions("component", "own", "node").mapInArrow(tidy(run), FOUND)


def _results(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, n, label = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), (), ())))
    none = [None] * len(node)
    return _rows(none, none, none, node, n, label, none)


def across_blocks(blocks: DataFrame, compare: Compare) -> DataFrame:
    """Compares the packed blocks of each component in pairs; (node, n, label) and edges between labels (node, null, label)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["component", "low", "high"]):
            if t.num_rows < 2:  # the other block got no member
                continue
            low, high = map(_unframe, t["data"].to_pylist())
            near = compare(low, high)
            a, b = stars(*linked_labels(near, low["label"].to_numpy(), high["label"].to_numpy()))
            n = len(a)
            counts = near @ high["copies"].to_numpy(), near.T @ low["copies"].to_numpy()
            data = [c.astype("<i8").tobytes() if c.any() else None for c in counts]
            own = [t["low"][0].as_py(), t["high"][0].as_py()]
            yield _rows([t["component"][0].as_py()] * 2 + [None] * n, own + [None] * n, [0, 0] + [None] * n, [None, None, *a.tolist()], [None] * (n + 2), [None, None, *b.tolist()], data + [None] * n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["component", "own"]):  # the block itself leads its counts
            block, *counts = t["data"].to_pylist()
            block = _unframe(block)
            n = block["n"].to_numpy() + sum(np.frombuffer(c, "<i8") for c in counts)
            yield _results([(block["node"].to_numpy()[n > 0], n[n > 0], block["label"].to_numpy()[n > 0])])

    each = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own")
    each = each.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "data")
    found = checkpointed(each.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "own").mapInArrow(tidy(pairs), FOUND))
    slim = blocks.select("component", "own", "blocks", "node", "n", "label", "data")
    counts = slim.unionByName(found.where("data is not null")).repartition("component", "own").sortWithinPartitions("component", "own", F.desc("blocks")).mapInArrow(tidy(total), FOUND)
    return counts.unionByName(found.where("node is not null"))


def all_pairs(members: DataFrame, compare: Compare, block: int) -> DataFrame:
    """(node, n, label): compares all members of each component.

    `members` has component, node, copies, load and what `compare` reads.  Sum `n`
    by node for the number of near copies; (node, label) are edges that join the
    nodes that links join.  A component without large ones never leaves its task.
    """
    first = checkpointed(inside_blocks(dealt_in_blocks(members, block).drop("load"), compare, keep=True))
    found, blocks = first.where("node is not null"), first.where("data is not null")
    if not blocks.isEmpty():
        found = found.unionByName(across_blocks(blocks, compare))
    return checkpointed(found.select("node", F.coalesce("n", F.lit(0)).alias("n"), "label"))
