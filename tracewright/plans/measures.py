"""Measures of running work: stragglers by running moments, and tasks of batch jobs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import workers_find_package
from ..sources.tables import Tables


@dataclass
class RunningMoments:
    """Count, mean and sum of squared deviations of what has passed; two of them merge without loss."""

    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def add(self, x: float) -> None:
        self.n += 1
        apart = x - self.mean
        self.mean += apart / self.n
        self.squares += apart * (x - self.mean)

    def merge(self, other: RunningMoments) -> RunningMoments:
        n = self.n + other.n
        if not n:
            return RunningMoments()
        apart = other.mean - self.mean
        return RunningMoments(n, self.mean + apart * other.n / n, self.squares + other.squares + apart * apart * self.n * other.n / n)

    @property
    def deviation(self) -> float:
        """Of the whole population."""
        return math.sqrt(self.squares / self.n) if self.n else 0.0


def running_stragglers(profile: DataFrame, worker: str, order: list[str], elapsed: str, deviations: float = 2.0, least: float = 1.0) -> DataFrame:
    """Records of `profile` that took longer than `least` and than the mean plus so many deviations of what their worker had done before.

    A worker's records pass one after the other in the given order, and only its moments are
    held.  A null time is no measure; a worker's first record is never a straggler.
    """
    workers_find_package(profile.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, moments = None, RunningMoments()
        for batch in batches:
            late = []
            for name, x in zip(batch.column(worker).to_pylist(), batch.column(elapsed).to_pylist(), strict=True):
                if name != now:
                    now, moments = name, RunningMoments()
                late.append(x is not None and moments.n > 0 and x > moments.mean + deviations * moments.deviation and x > least)
                if x is not None:
                    moments.add(x)
            yield batch.filter(pa.array(late, pa.bool_()))

    return profile.repartition(worker).sortWithinPartitions(worker, *order).mapInArrow(run, profile.schema)


_LATENCY = "value * ((event_id * 7919) % 97) / 97.0"


@query("debug_running_stragglers", f"""WITH p AS (SELECT event_id, user_id % 8 AS worker, {_LATENCY}::DOUBLE AS ms FROM events),
m AS (SELECT *, avg(ms) OVER before AS mean, stddev_pop(ms) OVER before AS std FROM p WINDOW before AS (PARTITION BY worker ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT worker, count(*) AS stragglers, sum(event_id)::BIGINT AS ids FROM m WHERE ms > mean + 2 * std AND ms > 1 GROUP BY worker""")
def debug_running_stragglers(t: Tables) -> DataFrame:
    profile = t.events.selectExpr("event_id", "user_id % 8 AS worker", f"CAST({_LATENCY.replace('97.0', '97.0D')} AS DOUBLE) AS ms")
    found = running_stragglers(profile, "worker", ["event_id"], "ms")
    return found.groupBy("worker").agg(F.count("*").alias("stragglers"), F.sum("event_id").alias("ids"))


class MeasuredJobs:
    """Tasks of the batch jobs that run inside a `with` block, from the status store (the UI need not run).

    `tasks()` gives a row per task that ended: stage, operators, task, attempt, executor,
    status, run_ms, records_read (from files), records_written, shuffle_read and shuffle_written.
    The store forgets the oldest tasks beyond spark.ui.retainedTasks.
    """

    KIND = "stage int, operators string, task long, attempt int, executor string, status string, run_ms long, records_read long, records_written long, shuffle_read long, shuffle_written long"

    def __init__(self, spark: SparkSession):
        self.spark, self.group = spark, f"measured-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> MeasuredJobs:
        self.spark.sparkContext.setJobGroup(self.group, "measured")
        return self

    def __exit__(self, *_) -> None:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.spark.sparkContext.setLocalProperty(name, None)

    def tasks(self) -> DataFrame:
        sc = self.spark.sparkContext
        scala = sc._jsc.sc()
        scala.listenerBus().waitUntilEmpty()  # events reach the store after the action returns
        store, rows = scala.statusStore(), []
        jobs = sc.statusTracker().getJobIdsForGroup(self.group)
        for stage in sorted({s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}):
            last = store.lastStageAttempt(stage)
            if last.numCompleteTasks() + last.numFailedTasks() == 0:
                continue  # skipped
            found = store.taskList(stage, last.attemptId(), 1 << 20)
            for i in range(found.size()):
                task = found.apply(i)
                if task.taskMetrics().isEmpty():
                    continue
                m = task.taskMetrics().get()
                rows.append((
                    stage, last.name(), task.taskId(), task.attempt(), task.executorId(), task.status(), m.executorRunTime(), m.inputMetrics().recordsRead(), m.outputMetrics().recordsWritten(),
                    m.shuffleReadMetrics().recordsRead(), m.shuffleWriteMetrics().recordsWritten(),
                ))
        return self.spark.createDataFrame(rows, self.KIND)


@query("debug_task_metrics", "SELECT (SELECT count(*) FROM lineitem) AS records_read, true AS shuffled_as_written")
def debug_task_metrics(t: Tables) -> DataFrame:
    """What the tasks of a job have read adds up to the table, and what was shuffled out was shuffled in."""
    with MeasuredJobs(t.spark) as jobs:
        t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).write.format("noop").mode("overwrite").save()
    sums = jobs.tasks().agg(F.sum("records_read").alias("records_read"), F.sum("shuffle_read").alias("r"), F.sum("shuffle_written").alias("w"))
    return sums.select("records_read", (F.col("r") == F.col("w")).alias("shuffled_as_written"))
