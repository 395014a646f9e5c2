"""Operator 4: near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label are ordered by their concatenated random
hyperplane bits, neighbours within a bounded window are compared in double
precision, and verified pairs are united across the passes.  Identical vectors
are one class with a multiplicity and a number of its own, so copies are neither
sorted nor expanded.  The windows give the connection; all links inside a found
component are then counted exactly, block by block, so a window's bound loses no
link there.

How many passes are enough is measured, not assumed.  A pair at the threshold
agrees in its first bits with a known chance, so the bits that a vector shares
with its neighbour at the window's end tell the chance that a pass misses a
partner of it.  Vectors for which that chance over all passes so far exceeds
`miss` (those in dense regions) go through further passes, whatever the size of
the label; what is left after `rounds` times as many is compared exactly, in pairs
of blocks.  A vector that is linked with half a window of its neighbours is not
counted among them: it lies inside a tight group, and a partner of it meets so many
members of that group that one of them connects the two.

Range partitioning on (pass, label, bits) splits a label of any size; a
partition's border hides at most `window` neighbours of one pass.

Defined cases: vectors that are null, zero, or hold null or non-finite parts,
rows without a label and rows without an id link with nothing (n_links 0, own
component, kept); rows that repeat an id are vectors of their own, each with its
own links; vectors of different lengths or labels never link; ids have to be
integers; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, partitions_for, tidy
from .components import all_pairs, connected_components, join_counted, smallest_ids, stars

BITS = 60
BLOCK = 1024


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(turn: int, width: int) -> np.ndarray:
    return np.random.default_rng([turn, width, 4]).standard_normal((width, BITS))


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits, of BITS, in which two codes agree."""
    return BITS - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64).clip(max=BITS)


def _found(a: list, b: list, who: list, turns: list, gain: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    a, b = stars(np.concatenate([none, *a]), np.concatenate([none, *b]))
    gains = np.concatenate([np.zeros(len(a)), *gain])
    columns = [np.concatenate([a, *who]), np.concatenate([b, *turns]).astype(np.int64), pa.array(gains, mask=np.arange(len(gains)) < len(a))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["a", "b", "gain"])


LOAD = "ceil(size(v) / 1024)"


def _by_label(classes: DataFrame) -> DataFrame:
    """The vectors of a label and length as one component to compare whole."""
    return classes.select(F.xxhash64("label", "width").alias("component"), F.col("rep").alias("node"), F.concat_ws(" ", "width", "label").alias("key"), "copies", "v", F.expr(LOAD).alias("load"))


def _near(low: pa.Table, high: pa.Table, threshold: float) -> np.ndarray:
    return _matrix(low["v"]) @ _matrix(high["v"]).T >= threshold


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, passes: int = 16, window: int = 48, miss: float = 0.01, rounds: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept)."""
    bounded_batches(vectors.sparkSession)
    v = F.col("v")
    kind = vectors.schema[id_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    base = base.withColumn("h1", F.when(usable, F.xxhash64("label", "v"))).withColumn("h2", F.when(usable, F.xxhash64(F.lit(7), "v", "label")))
    classes = base.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = checkpointed(classes.withColumn("width", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    differ = math.acos(max(-1.0, min(1.0, threshold))) / math.pi  # chance that a pair at the threshold differs in a bit
    enough = -math.log(miss)
    usual = enough / passes  # what a pass adds to the log chance of a find where it is good enough by itself

    def sign(turns: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rep, label, width, vec = batch.columns
                for w in np.unique(width.to_numpy()):
                    rows = pa.array(np.flatnonzero(width.to_numpy() == w))
                    x = _matrix(vec.take(rows))
                    for turn in turns:
                        bits = (x @ _planes(turn, int(w)) > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), turn, np.int32)), label.take(rows), width.take(rows), pa.array(bits), rep.take(rows), vec.take(rows)], ["turn", "label", "width", "bits", "rep", "v"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b, null), and (vector, turn, gain) for vectors that a pass serves worse than usual."""
        kept: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            before = 0 if kept is None else kept.num_rows
            t = t if kept is None else pa.concat_tables([kept, t]).combine_chunks()
            width, turn = t["width"].to_numpy(), t["turn"].to_numpy()
            label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            change = np.flatnonzero((width[1:] != width[:-1]) | (turn[1:] != turn[:-1]) | (label[1:] != label[:-1])) + 1
            rep, bits, vec = t["rep"].to_numpy(), t["bits"].to_numpy(), t["v"].combine_chunks()
            a, b, who, turns, gain = [], [], [], [], []
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(rep)], strict=True):
                if j <= before:
                    continue
                x, r, code = _matrix(vec.slice(i, j - i)), rep[i:j], bits[i:j]
                links = np.zeros(j - i, np.int64)
                for step in range(1, min(window, j - i - 1) + 1):
                    near = np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold
                    links[:-step] += near
                    links[step:] += near
                    near = np.flatnonzero(near)
                    near = near[near + step >= before - i]
                    a.append(r[near])
                    b.append(r[near + step])
                if j - i > window:
                    far = _shared_bits(code[:-window], code[window:])
                    deep = np.zeros(j - i, np.int64)
                    deep[window:] = far + 1
                    deep[:-window] = np.maximum(deep[:-window], far + 1)
                    gained = -np.log1p(-((1 - differ) ** deep).clip(max=1 - 1e-12))
                    # a row of two batches is told twice: the smaller gain counts
                    poor = np.flatnonzero((deep > 0) & (gained < usual) & (2 * links < window))
                    who.append(r[poor])
                    turns.append(turn[i + poor])
                    gain.append(gained[poor])
            yield _found(a, b, who, turns, gain)
            kept = t.slice(max(0, t.num_rows - window))

    def in_label(low: pa.Table, high: pa.Table) -> np.ndarray:
        out = np.zeros((low.num_rows, high.num_rows), bool)
        for key in set(low["key"].to_pylist()) & set(high["key"].to_pylist()):
            i, j = (np.flatnonzero(np.array(t["key"].to_pylist()) == key) for t in (low, high))
            out[np.ix_(i, j)] = _near(low.take(pa.array(i)), high.take(pa.array(j)), threshold)
        return out

    grown = "a long, b long, gain double"
    order = ["turn", "label", "width", "bits", "rep"]
    parts = partitions_for(vectors, 4)
    todo, turn, edges, sums = classes, 0, None, None
    while True:
        signed = todo.select("rep", "label", "width", "v").mapInArrow(tidy(sign(range(turn, turn + passes))), "turn int, label string, width int, bits long, rep long, v array<double>")
        found = checkpointed(signed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(compare), grown))
        turn += passes
        new = found.where("gain is null").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        poor = found.where("gain is not null").groupBy(F.col("a").alias("rep"), F.col("b").alias("turn")).agg(F.min("gain").alias("gain"))
        poor = poor.groupBy("rep").agg((F.sum("gain") + (passes - F.count("*")) * F.lit(usual)).alias("gain"))
        if sums is not None:
            poor = sums.join(poor, "rep", "left").select("rep", (F.col("before") + F.coalesce("gain", F.lit(enough))).alias("gain"))
        sums = checkpointed(poor.where(F.col("gain") < enough * (1 - 1e-9)).select("rep", F.col("gain").alias("before")))
        if sums.isEmpty():
            break
        todo = classes.join(sums.select("rep"), "rep", "left_semi")
        if turn == rounds * passes:
            edges = edges.unionByName(all_pairs(_by_label(todo), in_label, BLOCK).select(F.col("node").alias("a"), F.col("label").alias("b")))
            break
    groups = connected_components(edges)

    def near(low: pa.Table, high: pa.Table) -> np.ndarray:
        return _near(low, high, threshold)

    members = groups.join(classes.select(F.col("rep").alias("node"), "copies", "v"), "node").withColumn("load", F.expr(LOAD))
    pairs = all_pairs(members, near, BLOCK)
    links = pairs.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(pairs.select(F.col("node").alias("a"), F.col("label").alias("b")))
    low = smallest_ids(classes.select(F.col("rep").alias("node"), "least"), groups, groups.count())
    known = classes.select("h1", "h2", "rep", "least", "copies").join(links.withColumnRenamed("node", "rep"), "rep", "left").join(low.select(F.col("node").alias("rep"), F.col("least").alias("component")), "rep", "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"), F.col("copies").alias("n"))
    total = classes.agg(F.sum("copies")).first()[0] or 0
    out = join_counted(base.where("h1 is not null").select("id", "h1", "h2"), known, ["h1", "h2"], total).select("id", "n_links", "component")
    out = out.unionByName(base.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
