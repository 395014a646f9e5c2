"""Operator 10: n-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles.  A set's sketch has one sampled token
for each of 128 coordinates (the smallest under a hash function of its own, so
that the coordinates are independent for sets of any size).  A run starts with
all sets in one node; at a node every coordinate is sampled with probability
1 / (threshold * 128), and the sets of the node are split by their token at the
sampled coordinates.  Two sets at the threshold share one child on average, so
the path process stays critical, while dissimilar sets part quickly.  Runs are
repeated until their number gives the target recall at the threshold.

The first `FIRST` runs come alone: nodes that hold sets of one group only, by the
edges they found, are dropped from the others, since the last step compares all
sets of a group exactly.  Sets that meet in nodes of more than `CROWD` meet in many
of them: such a crowd is compared as a whole, each set once, where its pairs cost at
most `PAIRS` comparisons per set of the corpus, and nodes inside a crowd are dropped.
Of what is left, buckets, the nodes of at most `LIMIT` sets, are compared by brute force on the
sketches, and so are larger nodes of one group and few other sets.  A node of many groups that is larger is compared in blocks, which
joins what belongs together there; if all pairs of blocks are too many, its sets
then go through further runs of their own, to more levels and as many as these
take for the same recall.

Equal sets are one class with a multiplicity and a number of its own; copies are
neither split nor expanded.  Large nodes and groups are compared in packed
blocks and pairs of blocks, so none has to fit one task, and the exact step
covers all pairs of a group.

Defined cases: texts without words and rows without an id link with nothing; a
text of fewer than five words has one shingle of all its words; rows that repeat
an id are documents of their own, each with its own text's links; ids have to
be integers; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, mix, text_groups, tidy
from .components import all_pairs, connected_components, inside_blocks, join_counted, smallest_ids
from .words import Words

COORDINATES = 128
DEPTH = 3
FIRST = 3  # runs before the first look at what they have joined
LIMIT = 256
CROWD = 64
DEEPER = 4
PAIRS = 1000  # comparisons per set that brute force may cost in all where further runs could take its place
BLOCK = 512  # sets compared at once on sketches
EXACT = 2048  # and on shingle sets of up to USUAL shingles
USUAL = 512
#: Odd multipliers: a hash function of (well mixed) shingle codes for each coordinate.
FACTORS = np.random.default_rng(10).integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Per row the smallest hash of each of the independent hash functions, 16 bits of it; zeros for a row without shingles."""
    out = np.zeros((n, COORDINATES), np.uint16)
    some, first = np.unique(row, return_index=True)
    if len(some):
        code = mix(code)
        for c in range(COORDINATES):
            out[some, c] = mix(np.minimum.reduceat(code * FACTORS[c], first)) >> np.uint64(48)
    return out


def agreement(threshold: float) -> np.ndarray:
    """Chance that a pair of the threshold similarity agrees in 0, 1, ... all coordinates."""
    return np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)])


def least_agreement(recall: float, threshold: float) -> int:
    """Coordinates in which a candidate agrees at least; below lies at most a tenth of the misses allowed at the threshold."""
    return int(np.searchsorted(np.cumsum(agreement(threshold)), (1.0 - recall) / 10, "right"))


def survival(depth: int, threshold: float) -> float:
    """Chance that a pair of the threshold similarity still shares a node after `depth` levels."""
    p = 1.0 / COORDINATES  # sampled and equal
    q = 1.0
    for _ in range(depth):
        q = 1.0 - (1.0 - p * q) ** COORDINATES
    return q


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs so that a pair of the threshold similarity is missed in all of them with half of the allowed chance.

    The sketches are the same in all runs, so the chance is taken over the coordinates in which a pair agrees.
    """
    agreeing, chance = np.arange(COORDINATES + 1), agreement(threshold)
    below = np.ones(COORDINATES + 1)
    for _ in range(depth - 1):
        below = 1.0 - (1.0 - below / (threshold * COORDINATES)) ** agreeing
    missed = np.ones(COORDINATES + 1)
    seen, runs = agreeing >= least_agreement(recall, threshold), 0
    while chance @ np.where(seen, missed, 1.0) > (1.0 - recall) / 2:
        missed *= (1.0 - agreeing / COORDINATES * below) ** len(root_coordinates(runs, threshold))
        runs += 1
    return runs


def root_coordinates(run: int, threshold: float) -> range:
    """The coordinates that a run samples at its root: 1 / threshold of them on average, at least one, and other ones than the runs before."""
    return range(int(run / threshold), int((run + 1) / threshold))


def depart(sketch: np.ndarray, runs: range, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of the runs' roots, that hold all sets: (index of the set, node)."""
    index, node = [], []
    for run in runs:
        for c in (at % COORDINATES for at in root_coordinates(run, threshold)):
            token = sketch[:, c].astype(np.uint64) | np.uint64(c << 16 | 1 << 40)
            index.append(np.arange(len(sketch)))
            node.append(mix(mix(np.full(len(sketch), run + 1, np.uint64)) ^ mix(token)))
    return np.concatenate(index), np.concatenate(node)


def descend(node: np.ndarray, sketch: np.ndarray, index: np.ndarray, threshold: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Follows the chosen paths of all sets for some levels: (index of the set, node) of every path's end."""
    most = np.uint64(int((1 << 64) / (threshold * COORDINATES)))
    for _ in range(levels):
        nodes, which = np.unique(node, return_inverse=True)
        parts = []
        for c in range(COORDINATES):
            chosen = mix(nodes + np.uint64((c + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) < most
            rows = np.flatnonzero(chosen[which])
            if len(rows):
                token = sketch[index[rows], c].astype(np.uint64) | np.uint64(c << 16 | 1 << 40)
                parts.append((index[rows], mix(node[rows] ^ mix(token))))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        index, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return index, node


def _unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, component_id, kept, text_hash): links count all other documents of at least the threshold; the hash is Spark's xxhash64."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                n = end - start
                row, code = Words(batch.column(1).slice(start, n)).shingles(shingle)
                size, *sums = set_hashes(row, code, n)
                rows = sketches(row, code, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(2).slice(start, n), *[pa.array(h, mask=size == 0) for h in sums], pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "tag", "h1", "h2", "sketch"])

    sets = checkpointed(base.mapInArrow(tidy(sketch), "id long, tag long, h1 long, h2 long, sketch binary"))
    classes = sets.where("id is not null and h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes.withColumn("rep", F.monotonically_increasing_id()))
    number = classes.count()
    runs, more = runs_for(recall, threshold), runs_for(recall, threshold, DEPTH + DEEPER)
    sketched = classes.select("rep", "sketch")
    walked = "rep long, component long, node long"

    def walk(levels: int, roots: range | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rep, component, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unpack(batch.column(2))
                if roots is not None:
                    index, node = depart(rows, roots, threshold)
                else:
                    index, node = np.arange(len(rep)), batch.column(3).to_numpy().view(np.uint64)
                index, node = descend(node, rows, index, threshold, levels)
                yield pa.RecordBatch.from_arrays([pa.array(rep[index]), pa.array(component[index]), pa.array(node.view(np.int64))], ["rep", "component", "node"])

        return run

    least = least_agreement(recall, threshold)

    def alike(low: pa.Table, high: pa.Table) -> np.ndarray:
        a, b = _unpack(low["sketch"]), _unpack(high["sketch"])
        return np.stack([(b == row).sum(1) >= least for row in a])

    def grouped_sets(groups: DataFrame | None, only: DataFrame | None = None) -> DataFrame:
        """(rep, component, sketch); a set that no edge is known of is a component of its own."""
        chosen = sketched if only is None else sketched.join(only, "rep", "left_semi")
        if groups is None:
            return chosen.select("rep", F.col("rep").alias("component"), "sketch")
        return chosen.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "sketch")

    def mixed(paths: DataFrame) -> DataFrame:
        """The paths (rep, component, node, n, first) into nodes that hold sets of several components; n is the number of the node's sets, first the smallest."""
        size = paths.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return paths.join(size.select("node", "n", "first"), "node").select("rep", "component", "node", "n", "first")

    def crowds(several: DataFrame) -> DataFrame | None:
        """(rep, crowd) of the sets that nodes of more than `CROWD` join, and of the others in nodes that are half of one crowd.

        The smallest crowds, as long as all their pairs are at most `PAIRS` for each set of the corpus; none: None.
        """
        busy = several.where(f"n > {CROWD}")
        if PAIRS <= 0 or busy.isEmpty():
            return None
        seeds = connected_components(busy.select(F.col("first").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("crowd"))
        inside = several.select("rep", "node", "n").join(seeds, "rep", "left")
        most = inside.where("crowd is not null").groupBy("node", "crowd").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m < n and 2 * m >= n")
        added = inside.where("crowd is null").select("rep", "node").join(most.select("node", "crowd"), "node").groupBy("rep").agg(F.min("crowd").alias("crowd"))
        joined = checkpointed(seeds.unionByName(added))
        sizes = joined.groupBy("crowd").agg(F.count("*").alias("n"))
        cost = F.sum(F.col("n").cast("double") * F.col("n") * F.col("k")).over(Window.orderBy("n"))  # a row for each size that occurs
        largest = sizes.groupBy("n").agg(F.count("*").alias("k")).withColumn("cost", cost).where(F.col("cost") <= PAIRS * number).agg(F.max("n")).first()[0]
        if largest is None:
            return None
        return checkpointed(join_counted(joined, sizes.where(F.col("n") <= largest), ["crowd"], number))

    def compared(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidate edges (a, b) between the sets of each node, and the paths into large nodes of many components.

        Crowds are compared first, and nodes inside one are done by this.  The sets of a large node are dealt into blocks.  Where at most `LIMIT` of them are outside
        its largest component, these go to every block, which settles the node; else its blocks
        are compared each in itself, and the paths are returned for more.
        """
        several = checkpointed(mixed(paths))
        crowd, met = crowds(several), None
        if crowd is not None:
            members = crowd.join(sketched, "rep").select(F.col("crowd").alias("component"), F.col("rep").alias("node"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("load"), "sketch")
            met = all_pairs(members, alike, BLOCK).where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
            whole = several.join(crowd, "rep", "left").groupBy("node").agg(F.count("*").alias("n"), F.count("crowd").alias("m"), F.min("crowd").alias("x"), F.max("crowd").alias("y"))
            several = checkpointed(several.join(whole.where("n = m and x = y").select("node"), "node", "left_anti"))
        main = several.where(f"n > {LIMIT}").groupBy("node", "component").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", F.col("component").alias("main"))).alias("x"))
        large = checkpointed(several.where(f"n > {LIMIT}").join(main.select("node", "x.*"), "node"))
        few = F.col("n") - F.col("m") <= LIMIT
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("rep", "node"), blocks).cast("int")
        everywhere = few & (F.col("component") != F.col("main"))
        dealt = large.select("rep", "node", F.explode(F.when(everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("own"))
        rows = several.where(f"n <= {LIMIT}").select("rep", "node", F.lit(0).alias("own")).unionByName(dealt)
        rows = rows.join(sketched, "rep").select(F.col("node").alias("component"), "own", F.lit(1).alias("blocks"), F.col("rep").alias("node"), F.lit(1).cast("long").alias("copies"), "sketch")
        edges = checkpointed(inside_blocks(rows, alike, keep=False).where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        return edges if met is None else edges.unionByName(met), large.where(~few).select("rep", "node")

    # a few runs find most groups; later runs look at nodes that hold several of these only
    edges, rest = compared(checkpointed(grouped_sets(None).mapInArrow(tidy(walk(DEPTH - 1, range(FIRST))), walked)))
    groups = connected_components(edges)
    own = grouped_sets(groups)
    paths = own.mapInArrow(tidy(walk(DEPTH - 1, range(FIRST, runs))), walked).unionByName(own.select("rep", "component").join(rest, "rep"))
    more_edges, rest = compared(checkpointed(paths))
    edges, groups = edges.unionByName(more_edges), None
    turn, dense = 0, None
    while not rest.isEmpty():
        cost = rest.groupBy("node").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if cost <= PAIRS * number or turn > DEEPER:
            # what is left costs little, or is large and mixed at the last level: compared where it stands, in pairs of blocks
            members = rest.join(sketched, "rep").select(F.col("node").alias("component"), F.col("rep").alias("node"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("load"), "sketch")
            more_edges, rest = all_pairs(members, alike, BLOCK).select(F.col("node").alias("a"), F.col("label").alias("b")), rest.limit(0)
        else:
            if dense is None:
                # a pair that met in large nodes only is found by runs of the sets of such nodes alone, as many as the greater depth takes
                groups = connected_components(edges)
                left = mixed(grouped_sets(groups).select("rep", "component").join(rest, "rep")).select("rep").distinct()
                dense = checkpointed(grouped_sets(groups, left))
                paths = dense.mapInArrow(tidy(walk(DEPTH - 1, range(runs, runs + more))), walked)
            else:
                paths = dense.join(rest, "rep").select("rep", "component", "sketch", "node").mapInArrow(tidy(walk(1)), walked)
            more_edges, rest = compared(checkpointed(paths))
            turn += 1
        edges = edges.unionByName(more_edges)
        groups = None
    if groups is None:
        groups = connected_components(edges)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_groups(batch.column(3)):
                n = end - start
                row, code = Words(batch.column(3).slice(start, n)).shingles(shingle)
                first = np.searchsorted(row, np.arange(n + 1))
                _, h1, h2 = set_hashes(row, code, n)
                own = pa.array((h1 == batch.column(4).slice(start, n).to_numpy()) & (h2 == batch.column(5).slice(start, n).to_numpy()))  # not another text of the same id
                blob = code.tobytes()
                packed = pa.array([blob[8 * i : 8 * j] for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)], pa.binary())
                load = pa.array(1 + np.diff(first) // USUAL)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(start, n) for i in range(3)], load, packed], ["component", "node", "copies", "load", "codes"]).filter(own)

    known = groups.join(classes.select(F.col("rep").alias("node"), "copies", "h1", "h2", "least"), "node")
    found = known.join(base.where("id is not null"), F.col("least") == F.col("id")).select("component", "node", "copies", "text", "h1", "h2")
    members = found.mapInArrow(tidy(shingled), "component long, node long, copies long, load long, codes binary")

    def near(low: pa.Table, high: pa.Table) -> np.ndarray:
        return overlaps([np.frombuffer(c, np.uint64) for c in low["codes"].to_pylist()], [np.frombuffer(c, np.uint64) for c in high["codes"].to_pylist()], threshold)

    pairs = all_pairs(members, near, EXACT)
    links = pairs.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(pairs.select(F.col("node").alias("a"), F.col("label").alias("b")))
    low = smallest_ids(classes.select(F.col("rep").alias("node"), "least"), parts, parts.count())
    result = classes.select("h1", "h2", "rep", "least", "copies").join(links.withColumnRenamed("node", "rep"), "rep", "left").join(low.select(F.col("node").alias("rep"), F.col("least").alias("component")), "rep", "left")
    result = result.select("h1", "h2", F.col("least").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"), F.col("copies").alias("n"))
    mine = sets.where("id is not null and h1 is not null").select("id", "tag", "h1", "h2")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    joined = join_counted(mine, result, ["h1", "h2"], total).select("id", "tag", "class_id", "n_links", "component")
    alone = sets.where("id is null or h1 is null").select("id", "tag", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("component").alias("component_id"), kept.alias("kept"), F.col("tag").alias("text_hash"))


def set_hashes(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles of each row, and two 64-bit sums over them that name the set."""
    first = np.searchsorted(row, np.arange(n + 1))
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))[first] for x in (code, mix(code))]
    return np.diff(first), *[np.diff(x).view(np.int64) for x in sums]


def overlaps(low: list[np.ndarray], high: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of `low` and `high` reach the Jaccard threshold; counted by matrix products over shared tokens."""
    n, sets = len(low), [*low, *high]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    code, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    inter = np.zeros((n, len(high)), np.float32)
    width = max(64, (4 << 20) // len(sets))
    for c in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(at, [c, c + width])
        x = np.zeros((len(sets), min(width, int(shared.sum()) - c)), np.float32)
        x[owner[i:j], at[i:j] - c] = 1.0
        inter += x[:n] @ x[n:].T
    union = size[:n, None] + size[None, n:] - inter
    return inter >= threshold * union - 1e-6
