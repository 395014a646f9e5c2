"""Operator 11: centroid clustering with float32 screening and exact decisions.

Components are turned into integers.  A batch of vectors meets all centroids in
one float32 matrix product, and every product comes with a rigorous error bound:
a dot product of n integers is off by at most n u / (1 - n u) times the product
of the two lengths (u = 2^-24, any order of summation, fused or not), and by
nothing where that product of lengths stays below 2^24, as all partial sums are
then integers that a float32 holds.  Centroids whose interval reaches below the
best upper end are a vector's shortlist; a shortlist of several is decided by
exact integer distances, the smallest number first.

Per task the vectors of a cluster are summed before anything is shuffled, so a
round moves one row per task, cluster and limb, whatever share of the vectors one
cluster holds; only centroids reach the driver.  A round reads the table again:
nothing is cached, and a lost executor costs its tasks alone.

Integers beyond `SAFE` (2^20) leave the screening: their rows are compared in
Python's integers, and sums travel in limbs of 20 bits, so any finite double is
clustered exactly.

Defined cases: vectors that are null, of another length, or hold null or
non-finite components are left out; fewer kept vectors than centroids give as
many centroids as vectors; rows that repeat an id are vectors of their own (as
first centroids, equal hashes are ordered by components); a row without an id is
clustered, but is no first centroid; a distance or sum beyond a long is null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

SAFE = 1 << 20
LIMB = 20
LONG = 1 << 63
BLOCK = 1 << 14
SCALE = 64


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, smallest number first."""

    rows: list[list[int]]

    @property
    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.rows]


def whole(x: float) -> int:
    """floor(64 x), exactly."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def screen(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for integer rows within SAFE; whole numbers in doubles."""
    n = x.shape[1]
    u = 2.0**-24
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    lengths = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt((c * c).sum(1).astype(np.float64))[None, :] * (1 + 1e-12)
    off = np.where(lengths < 2**24, 0.0, np.ceil(lengths * (n * u / (1 - n * u)) * (1 + 1e-12)))
    own = (c * c).sum(1).astype(np.float64)
    return own - 2 * (dot + off), own - 2 * (dot - off)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of integer rows within SAFE; ties go to the smaller number."""
    low, high = screen(x, c)
    row, number = np.nonzero(low <= high.min(1, keepdims=True))
    apart = x[row] - c[number]
    distance = np.einsum("ij,ij->i", apart, apart)
    order = np.lexsort((number, distance, row))
    first = order[np.searchsorted(row[order], np.arange(len(x)))]
    return number[first], distance[first]


def nearest_of_any(row: list[int], centroids: Centroids) -> tuple[int, int]:
    distance, number = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(centroids.rows))
    return number, distance


def assign(vectors: pa.Array, centroids: Centroids) -> tuple[np.ndarray, list[int | None] | np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(cluster, distance, integer rows, rows beyond SAFE by place) of a batch of kept vectors."""
    n = len(vectors)
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    plain = (np.abs(v) <= SAFE / SCALE).all(1)
    x = np.floor(np.where(plain[:, None], v, 0) * SCALE).astype(np.int64)
    peaks = [max(map(abs, row)) for row in centroids.rows]
    numbers = np.flatnonzero([p <= SAFE for p in peaks])
    # beyond `far` a centroid is farther from a plain row than any that is within SAFE
    far = SAFE * (2 * math.isqrt(v.shape[1]) + 3)
    if not len(numbers) or any(SAFE < p <= far for p in peaks):
        plain[:] = False
    cluster, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if plain.any():
        c = np.array([centroids.rows[k] for k in numbers], np.int64)
        at = np.flatnonzero(plain)
        for i in range(0, len(at), BLOCK):
            rows = at[i : i + BLOCK]
            number, distance[rows] = nearest(x[rows], c)
            cluster[rows] = numbers[number]
    large, out = {}, distance
    if not plain.all():
        out = distance.tolist()
        for i in np.flatnonzero(~plain):
            large[int(i)] = [whole(a) for a in v[i].tolist()]
            cluster[i], out[i] = nearest_of_any(large[int(i)], centroids)
    return cluster, out, x, large


def _limbs(row: list[int]) -> Iterator[list[int]]:
    while any(row):
        done = all(-SAFE <= a < SAFE for a in row)
        yield row if done else [a & (SAFE - 1) for a in row]
        row = [0] * len(row) if done else [a >> LIMB for a in row]


def _sums(centroids: Centroids, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: (cluster, limb, [vectors, sums of components, sum of distances]); a limb k counts 2^(LIMB k) times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance, x, large = assign(batch.column("v"), centroids)
            plain = np.array([0 if i in large else d for i, d in enumerate(distance)], np.int64) if large else distance
            x[list(large)] = 0
            low = np.column_stack([np.ones_like(plain), x, plain & (SAFE - 1)])
            for k in np.unique(cluster):
                own = cluster == k
                high = np.zeros(width + 2, np.int64)
                high[-1] = (plain[own] >> LIMB).sum()
                for limb, part in enumerate([low[own].sum(0), high]):
                    total[int(k), limb] = total.get((int(k), limb), 0) + part
            for i, row in large.items():
                for limb, values in enumerate(_limbs([*row, distance[i]])):
                    total[int(cluster[i]), limb] = total.get((int(cluster[i]), limb), 0) + np.array([0, *values], np.int64)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([limb for _, limb in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.int64()))],
                ["cluster", "limb", "sums"],
            )

    return run


def _totals(vectors: DataFrame, centroids: Centroids, width: int) -> dict[int, tuple[int, list[int], int]]:
    """(vectors, sums of components, sum of distances) of every non-empty cluster."""
    parts = vectors.select("v").mapInArrow(tidy(_sums(centroids, width)), "cluster int, limb int, sums array<long>")
    # decimals: distances of all vectors may add up to more than a long
    parts = parts.groupBy("cluster", "limb").agg(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width + 2)])
    out: dict[int, list[int]] = {}
    for row in parts.collect():  # a row per cluster and limb
        now = out.setdefault(row.cluster, [0] * (width + 2))
        for i in range(width + 2):
            now[i] += int(row[f"s{i}"]) << (LIMB * row.limb)
    return {k: (row[0], row[1:-1], row[-1]) for k, row in out.items()}


def kept_vectors(vectors: DataFrame, width: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors with exactly `width` finite components."""
    v: Column = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == width) & finite)


def first_centroids(kept: DataFrame, k: int, seed: int) -> Centroids:
    """The `k` vectors of smallest sha256 of `<seed>:<id>`."""
    ranked = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return Centroids([[whole(x) for x in row.v] for row in ranked.orderBy("h", "v").limit(k).collect()])


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    bounded_batches(vectors.sparkSession)
    kept = kept_vectors(vectors, width, id_col, vec_col)
    kind = vectors.schema[id_col].dataType
    centroids = first_centroids(kept, k, seed)
    if not centroids.rows:
        return _described(kept.where("false"), Centroids([]), {}, kind.simpleString(), id_col)
    for _ in range(rounds):
        rows = list(centroids.rows)
        for number, (n, sums, _) in _totals(kept, centroids, width).items():
            rows[number] = [s // n for s in sums]
        centroids = Centroids(rows)
    return _described(kept, centroids, _totals(kept, centroids, width), kind.simpleString(), id_col)


def _described(kept: DataFrame, centroids: Centroids, totals: dict[int, tuple[int, list[int], int]], kind: str, id_col: str) -> DataFrame:
    def fits(n: int) -> int | None:
        return n if n < LONG else None

    digests = centroids.digests
    inertias = [fits(totals[c][2]) if c in totals else None for c in range(len(digests))]
    inertia = fits(sum(t[2] for t in totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _, large = assign(batch.column("v"), centroids)
                distance = [fits(d) for d in distance] if large else distance
                number = pa.array(cluster.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), number, pa.array(distance, pa.int64()), pa.array(inertias, pa.int64()).take(number), pa.array([inertia] * len(cluster), pa.int64()), pa.array(digests).take(number)],
                    [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return kept.mapInArrow(tidy(run), f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster_sql(k: int = 16, rounds: int = 3, width: int = 64, seed: int = 1) -> str:
    """DuckDB SQL for the same rows over the view `embeddings` (components that fit a long)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT vid, cluster, distance FROM (
    SELECT vid, cluster, distance, row_number() OVER (PARTITION BY vid ORDER BY distance, cluster) AS place
    FROM (SELECT x.vid, c.cluster, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS distance FROM comps x JOIN cents{r} c USING (dim) GROUP BY ALL))
  WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
cents{r + 1} AS (
  SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM cents{r} c LEFT JOIN (
    SELECT cluster, dim, ((s - ((s % n) + n) % n) // n)::BIGINT AS x
    FROM (SELECT a.cluster, x.dim, sum(x.x)::BIGINT AS s, count(*) AS n FROM near{r} a JOIN comps x USING (vid) GROUP BY ALL)) m
  USING (cluster, dim))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS vid, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding::DOUBLE[], lambda x: isfinite(x))) = {width}),
comps AS (SELECT vid, unnest(range({width})) AS dim, unnest(list_transform(v, lambda x: floor({SCALE} * x)::BIGINT)) AS x FROM kept),
started AS (
  SELECT vid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL
  ORDER BY cluster LIMIT {k}),
cents0 AS (SELECT cluster, dim, x FROM started JOIN comps USING (vid)),{",".join(steps)},
digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM cents{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (vid) JOIN digests USING (cluster)
"""
