"""Data debugging: watchpoints, breakpoints, crash capture and repair, latency.

All state is DataFrames.  A watchpoint leaves the flow as it is and offers the
matching records on the side.  A guarded step runs a Python function on each
record, once: its rows are materialised, failures among them, and everything
after that (skip, repair at once or later, fix, resolve) reads these rows and
runs the function on the failed records only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import reliable

LAZY_LIMIT = 500
VIEW = 10
SLOWEST = 10
DEVIATIONS = 2.0


@dataclass
class Watchpoint:
    """Records of a flow that meet a guard; the guard is SQL text and can be replaced while the flow goes on."""

    name: str
    df: DataFrame
    guard: str
    version: int = 0

    def replace(self, guard: str) -> None:
        self.guard, self.version = guard, self.version + 1

    def captured(self) -> DataFrame:
        """(op_id, partition_id, record)."""
        return self.df.where(F.expr(self.guard)).select(F.lit(self.name).alias("op_id"), F.spark_partition_id().alias("partition_id"), F.to_json(F.struct(*self.df.columns)).alias("record"))

    def view(self, k: int = VIEW) -> DataFrame:
        """The first records for a look; `captured` has them all."""
        return self.captured().limit(k)


def watchpoint(df: DataFrame, guard: str, name: str = "watch") -> tuple[DataFrame, Watchpoint]:
    """The unchanged flow, and the watchpoint beside it."""
    return df, Watchpoint(name, df, guard)


@dataclass
class Guarded:
    """Results of a guarded step, and its quarantine (rid, record, error)."""

    rows: DataFrame
    result: T.DataType
    record: list[str]
    function: Callable[[dict], Any]
    rid: str
    kind: str = "map"

    @property
    def ok(self) -> DataFrame:
        """Input columns and `result` of the records that went through."""
        good = self.rows.where("__error is null")
        if self.kind == "filter":
            return good.where("result").drop("result", "__error")
        if self.kind == "flat_map":
            good = good.withColumn("result", F.explode("result"))
        return good.drop("__error")

    @property
    def quarantine(self) -> DataFrame:
        return self.rows.where("__error is not null").select(F.col(self.rid).alias("rid"), F.struct(*self.record).alias("record"), F.col("__error").alias("error"))

    def _again(self, fixed: DataFrame) -> Guarded:
        return guarded(fixed.select(*self.record), self.function, self.result, self.rid, self.kind)

    def skip(self) -> DataFrame:
        """Mode s: failing records are left out."""
        return self.ok

    def modify(self, repairs: dict[str, Column]) -> DataFrame:
        """Mode m: failing records are repaired where they stand and run again at once."""
        failed = self.rows.where("__error is not null").select(*self.record).withColumns(repairs)
        return self.ok.unionByName(self._again(failed).ok)

    def lazy_modify(self, repaired: DataFrame, limit: int = LAZY_LIMIT) -> DataFrame:
        """Mode lm: the run goes on, and a batch of repaired records (with their ids) is run at the end.

        More failures than the limit stop it: so many need a fix of the function.
        """
        n = self.quarantine.limit(limit + 1).count()
        if n > limit:
            raise RuntimeError(f"more than {limit} records failed; replace the function or repair at once")
        return self.ok.unionByName(self._again(repaired).ok)

    def lazy_modify_all(self, repairs: dict[str, Column]) -> DataFrame:
        """Mode lm1: one repair for all failed records, applied at the end; without a limit."""
        return self.modify(repairs)

    def fix(self, function: Callable[[dict], Any]) -> Guarded:
        """A live code fix: the failed records are run with another function, the others keep their results."""
        failed = guarded(self.rows.where("__error is not null").select(*self.record), function, self.result, self.rid, self.kind)
        return Guarded(self.rows.where("__error is null").unionByName(failed.rows), self.result, self.record, function, self.rid, self.kind)

    def resolve(self, rid: Any, action: str, repairs: dict[str, Column] | None = None) -> Guarded:
        """Settles one failed record: `skip` drops it, `modify` repairs it and runs it again."""
        one = F.col("__error").isNotNull() & (F.col(self.rid) == F.lit(rid))
        rest = self.rows.where(~one)
        if action == "modify":
            rest = rest.unionByName(self._again(self.rows.where(one).select(*self.record).withColumns(repairs or {})).rows)
        elif action != "skip":
            raise ValueError(action)
        return Guarded(rest, self.result, self.record, self.function, self.rid, self.kind)


def _column(values: list, errors: list, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow column; one that is not of the kind becomes a failure of its record."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        for i, v in enumerate(values):
            try:
                pa.array([v], kind)
            except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                values[i], errors[i] = None, f"{type(e).__name__}: {e}"
        return pa.array(values, kind)


def guarded(df: DataFrame, function: Callable[[dict], Any], result: str | T.DataType, rid: str, kind: str = "map") -> Guarded:
    """Runs a function once on each record (a dict, nulls are None); failures are kept as `__error`.  kind: map, filter or flat_map."""
    if isinstance(result, str):
        result = T._parse_datatype_string(result)
    schema = T.StructType([*df.schema.fields, T.StructField("result", result), T.StructField("__error", T.StringType())])
    columns, arrow = df.columns, to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for record in batch.to_pylist():
                try:
                    values.append(function(record))
                    errors.append(None)
                except Exception as e:  # any failure of the user's function is data here
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            found = _column(values, errors, arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found, pa.array(errors, pa.string())], [*batch.schema.names, "result", "__error"])

    return Guarded(reliable(df.mapInArrow(run, schema)), result, columns, function, rid, kind)


def profiled(df: DataFrame, function: Callable[[dict], Any], result: str, op: str, rid: str) -> DataFrame:
    """(op, rid, value, elapsed_ns) of a function run on each record."""
    kind = T._parse_datatype_string(result)
    fields = [T.StructField("op", T.StringType()), T.StructField("rid", df.schema[rid].dataType), T.StructField("value", kind), T.StructField("elapsed_ns", T.LongType())]
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, spans = [], []
            for record in batch.to_pylist():
                start = time.perf_counter_ns()
                values.append(function(record))
                spans.append(time.perf_counter_ns() - start)
            yield pa.RecordBatch.from_arrays([pa.array([op] * len(spans), pa.string()), batch.column(rid), pa.array(values, arrow), pa.array(spans, pa.int64())], ["op", "rid", "value", "elapsed_ns"])

    return df.mapInArrow(run, T.StructType(fields))


def latency_summary(profile: DataFrame) -> DataFrame:
    """Mean and deviation of each operator, in milliseconds."""
    ms = F.col("elapsed_ns") / 1e6
    return profile.groupBy("op").agg(F.count("*").alias("records"), F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"))


def stragglers(profile: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Records slower than their operator's mean by so many deviations."""
    s = profile.groupBy("op").agg(F.avg("elapsed_ns").alias("__m"), F.stddev_pop("elapsed_ns").alias("__s"))
    return profile.join(F.broadcast(s), "op").where(F.col("elapsed_ns") > F.col("__m") + deviations * F.col("__s")).drop("__m", "__s")  # a row per operator


def slowest(profile: DataFrame, k: int = SLOWEST) -> DataFrame:
    w = Window.partitionBy("op").orderBy(F.desc("elapsed_ns"), "rid")
    return profile.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@dataclass
class DebugSession:
    """A recorded pipeline of named stages that can stop at breakpoints, go on, and have a stage replaced."""

    source: DataFrame
    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]
    breakpoints: set[str] = field(default_factory=set)
    position: int = 0
    state: DataFrame | None = None
    stopped: bool = False

    def breakpoint(self, name: str) -> None:
        """The state before this stage is materialised, so it can be looked at and resumed from."""
        self.breakpoints.add(name)

    def step(self) -> DataFrame:
        if self.stopped:
            raise RuntimeError("the session was stopped")
        if self.position < len(self.stages):
            self.state = self.stages[self.position][1](self.source if self.state is None else self.state)
            self.position += 1
        return self.source if self.state is None else self.state

    def resume(self) -> DataFrame:
        """Runs on to the next breakpoint or the end."""
        moved = False
        while self.position < len(self.stages):
            if moved and self.stages[self.position][0] in self.breakpoints:
                self.state = reliable(self.state)
                break
            self.step()
            moved = True
        return self.step() if not moved else self.state

    def replace(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> None:
        """A live fix of a stage that has not run yet."""
        self.stages = [(n, stage if n == name else f) for n, f in self.stages]

    def stop(self) -> None:
        self.stopped = True

    def kill_and_run(self) -> DataFrame:
        """Starts over with the stages as they are now."""
        self.position, self.state, self.stopped = 0, None, False
        return self.resume()
