"""User-defined mergeable aggregates.

An `Aggregator` is a zero, a reduction of rows into a state, a merge of two states
and a finish.  States are reduced where the rows are, so a task sends one state per
key it has seen (or flushes them when it holds too many); states of a key then meet
in two levels, first by (key, salt), then by key.  Both levels read sorted states
one after the other and hold one merged state at a time, so neither a hot key nor
a key that every task has seen fills a task.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..registry import query
from ..session import workers_find_package
from ..sources.tables import Tables


class Aggregator:
    """`columns` are read, `result` is the Spark type of what `finish` gives; a state is anything that pickles."""

    columns: list[str]
    result: str

    def zero(self) -> Any:
        raise NotImplementedError

    def reduce(self, state: Any, rows: dict[str, np.ndarray]) -> Any:
        """The state with a batch of rows of its key; nulls are NaN in number columns."""
        raise NotImplementedError

    def merge(self, one: Any, other: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> Any:
        return state


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, places) of the batch's rows."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    table = pa.table([*[batch.column(k) for k in keys], pa.array(np.arange(batch.num_rows))], names=[*map(str, range(len(keys))), "row"])
    found = table.group_by([str(i) for i in range(len(keys))]).aggregate([("row", "list")])
    places = found.column("row_list").combine_chunks()
    names = zip(*[found.column(str(i)).to_pylist() for i in range(len(keys))], strict=True)
    for i, key in enumerate(names):
        yield key, places[i].values.to_numpy()


def _rows(keys: list[str], kinds: list[pa.DataType], value: pa.DataType, pairs: list[tuple[tuple, Any]], name: str) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k, _ in pairs], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v for _, v in pairs], value)], [*keys, name])


def _reduced(agg: Aggregator, keys: list[str], kinds: list[pa.DataType], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in agg.columns}
            for key, places in _groups(batch, keys) if batch.num_rows else ():
                state = held[key] if key in held else agg.zero()
                held[key] = agg.reduce(state, {c: x[places] for c, x in columns.items()})
            if len(held) > most:
                yield _rows(keys, kinds, pa.binary(), [(k, pickle.dumps(s)) for k, s in held.items()], "state")
                held = {}
        if held:
            yield _rows(keys, kinds, pa.binary(), [(k, pickle.dumps(s)) for k, s in held.items()], "state")

    return run


def _merged(agg: Aggregator, keys: list[str], kinds: list[pa.DataType], value: pa.DataType, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring states of equal keys become one; keys are compared as they pickle, so NaN equals NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, state, out = None, (), None, []

        def done() -> None:
            out.append((key, agg.finish(state) if last else pickle.dumps(state)))

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows
            for name, blob in zip(names, batch.column("state").to_pylist(), strict=True):
                mark = pickle.dumps(name)
                if mark == now:
                    state = agg.merge(state, pickle.loads(blob))
                    continue
                if now is not None:
                    done()
                now, key, state = mark, name, pickle.loads(blob)
            if len(out) >= 1000:
                yield _rows(keys, kinds, value, out, "value" if last else "state")
                out.clear()
        if now is not None:
            done()
        if out:
            yield _rows(keys, kinds, value, out, "value" if last else "state")

    return run


def aggregate(df: DataFrame, keys: list[str], agg: Aggregator, name: str, salts: int = 8, most: int = 10_000) -> DataFrame:
    """(keys.., name): the aggregate of every group; without keys one row, or none if there are no rows.

    Null keys are a group of their own.  A task holds `most` states between batches; `salts` is
    the number of places in which a key's states first meet.
    """
    workers_find_package(df.sparkSession)
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    result = T._parse_datatype_string(agg.result)
    held = T.StructType([*fields, T.StructField("state", T.BinaryType())])
    states = df.select(*dict.fromkeys([*keys, *agg.columns])).mapInArrow(_reduced(agg, keys, kinds, most), held)
    states = states.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    states = states.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    states = states.mapInArrow(_merged(agg, keys, kinds, pa.binary(), False), held)
    states = states.repartition(*keys).sortWithinPartitions(*keys) if keys else states.coalesce(1)
    out = states.mapInArrow(_merged(agg, keys, kinds, to_arrow_type(result), True), T.StructType([*fields, T.StructField("value", result)]))
    return out.withColumnRenamed("value", name)


class WeightedMean(Aggregator):
    """Mean of a column by the weights of another; null without weight."""

    result = "double"

    def __init__(self, value: str, weight: str):
        self.columns = [value, weight]

    def zero(self) -> tuple[float, float]:
        return 0.0, 0.0

    def reduce(self, state: tuple[float, float], rows: dict[str, np.ndarray]) -> tuple[float, float]:
        x, w = (rows[c].astype(np.float64) for c in self.columns)
        ok = ~(np.isnan(x) | np.isnan(w))
        return state[0] + float((x[ok] * w[ok]).sum()), state[1] + float(w[ok].sum())

    def merge(self, one: tuple[float, float], other: tuple[float, float]) -> tuple[float, float]:
        return one[0] + other[0], one[1] + other[1]

    def finish(self, state: tuple[float, float]) -> float | None:
        return state[0] / state[1] if state[1] else None


class Moments(Aggregator):
    """Count, mean and sum of squared deviations, merged without loss by the difference of the means."""

    result = "struct<n: long, mean: double, variance: double>"

    def __init__(self, column: str):
        self.columns = [column]

    def zero(self) -> tuple[int, float, float]:
        return 0, 0.0, 0.0

    def reduce(self, state: tuple[int, float, float], rows: dict[str, np.ndarray]) -> tuple[int, float, float]:
        x = rows[self.columns[0]].astype(np.float64)
        x = x[~np.isnan(x)]
        if not len(x):
            return state
        mean = float(x.mean())
        return self.merge(state, (len(x), mean, float(((x - mean) ** 2).sum())))

    def merge(self, one: tuple[int, float, float], other: tuple[int, float, float]) -> tuple[int, float, float]:
        n = one[0] + other[0]
        if not n:
            return one
        apart = other[1] - one[1]
        return n, one[1] + apart * other[0] / n, one[2] + other[2] + apart * apart * one[0] * other[0] / n

    def finish(self, state: tuple[int, float, float]) -> dict:
        n, mean, squares = state
        return {"n": n, "mean": mean if n else None, "variance": squares / (n - 1) if n > 1 else None}


class Largest(Aggregator):
    """The k largest values, largest first; equal values count as often as they occur."""

    result = "array<double>"

    def __init__(self, column: str, k: int):
        self.columns, self.k = [column], k

    def zero(self) -> list[float]:
        return []

    def reduce(self, state: list[float], rows: dict[str, np.ndarray]) -> list[float]:
        x = rows[self.columns[0]].astype(np.float64)
        x = x[~np.isnan(x)]
        if len(x) > self.k:
            x = np.partition(x, len(x) - self.k)[-self.k :]
        return self.merge(state, x.tolist())

    def merge(self, one: list[float], other: list[float]) -> list[float]:
        return heapq.nlargest(self.k, [*one, *other])


class Quantiles(Aggregator):
    """Approximate quantiles from weighted means that are narrow at both ends.

    Neighbouring means merge while their weight stays within 4 n q (1 - q) / size, so a state has
    a few times `size` means and a quantile's rank is off by a fraction of that weight.
    """

    result = "array<double>"

    def __init__(self, column: str, at: list[float], size: int = 200):
        self.columns, self.at, self.size = [column], at, size

    def zero(self) -> np.ndarray:
        return np.zeros((0, 2))

    def reduce(self, state: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.columns[0]].astype(np.float64)
        x = x[~np.isnan(x)]
        return self.merge(state, np.column_stack([x, np.ones_like(x)]))

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        both = np.concatenate([one, other])
        both = both[np.argsort(both[:, 0], kind="stable")]
        if len(both) <= self.size:
            return both
        n = both[:, 1].sum()
        out, before, value, weight = [], 0.0, 0.0, 0.0
        for x, w in both.tolist():
            q = (before + (weight + w) / 2) / n
            if weight and weight + w > max(1.0, 4 * n * q * (1 - q) / self.size):
                out.append((value, weight))
                before, value, weight = before + weight, 0.0, 0.0
            value, weight = (value * weight + x * w) / (weight + w), weight + w
        out.append((value, weight))
        return np.array(out)

    def finish(self, state: np.ndarray) -> list[float] | None:
        if not len(state):
            return None
        middle = np.cumsum(state[:, 1]) - state[:, 1] / 2
        return np.interp(np.array(self.at) * state[:, 1].sum(), middle, state[:, 0]).tolist()


@query("agg_typed_aggregator", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_returnflag")
def agg_typed_aggregator(t: Tables) -> DataFrame:
    found = aggregate(t.lineitem, ["l_returnflag"], WeightedMean("l_extendedprice", "l_quantity"), "weighted")
    return found.select("l_returnflag", F.round("weighted", 4).alias("weighted"))


@query("agg_user_largest", "SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice), 'DESC')[1:5] AS top FROM lineitem GROUP BY ALL")
def agg_user_largest(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], Largest("l_extendedprice", 5), "top")


@query("agg_user_moments", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY l_suppkey")
def agg_user_moments(t: Tables) -> DataFrame:
    found = aggregate(t.lineitem, ["l_suppkey"], Moments("l_quantity"), "m")
    return found.select("l_suppkey", "m.n", F.round("m.mean", 6).alias("mean"), F.round("m.variance", 6).alias("variance"))


@query("agg_user_quantiles", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
def agg_user_quantiles(t: Tables) -> DataFrame:
    """The ranks of the estimated quartiles are within 1 % of what was asked."""
    at = [0.25, 0.5, 0.75]
    found = aggregate(t.lineitem, ["l_returnflag"], Quantiles("l_extendedprice", at), "q")
    ranks = t.lineitem.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag")  # three rows
    shares = ranks.agg(*[F.avg((F.col("l_extendedprice") <= F.col("q")[i]).cast("int")).alias(f"s{i}") for i in range(len(at))])
    close = [F.abs(F.col(f"s{i}") - q) < 0.01 for i, q in enumerate(at)]
    return shares.select("l_returnflag", (close[0] & close[1] & close[2]).alias("close"))
