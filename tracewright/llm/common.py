"""Shared plumbing of the training-data operators.

Text columns reach Python as Arrow batches.  `bounded_batches` keeps a batch
small in rows and, where Spark knows the setting, in bytes, so that a run of
very long texts cannot fill a worker.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_find_package

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: For operators that look up a group's distinct words: larger groups hold fewer of them.
GROUP_ROWS = 4000
GROUP_BYTES = 8 << 20


#: Large freed arrays go back to the system: idle workers would else hold the largest task's memory.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Caps the Arrow batches of the session at `rows` rows and 16 MB; unions don't take over partitionings."""
    workers_find_package(spark)
    spark.sparkContext.environment.update(WORKER_MEMORY)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # a union of checkpointed parts would claim their common partitioning and then zip parts of unlike counts
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "tracewright-shared")
    return found.rstrip("/")


#: Paths of the checkpoints that are made inside `dropped_checkpoints`.
_checkpoints: ContextVar[list[str] | None] = ContextVar("checkpoints", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def dropped_checkpoints(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside go at the end: what is computed from them has to be written by then."""
    made: list[str] = []
    token = _checkpoints.set(made)
    try:
        yield
    finally:
        _checkpoints.reset(token)
        for path in made:
            remove(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    made = _checkpoints.get()
    if made is not None:
        made.append(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    gc.collect()
    sc._jvm.System.gc()  # lets the cleaner drop the shuffle files of what was cut off
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tracewright-{name}-{uuid.uuid4().hex[:12]}"


#: Steps over a scan that give each row at most once.
_NARROW = {"Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan only chooses rows and columns of one scan of files."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _NARROW and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") and node.relation().getClass().getSimpleName() == "HadoopFsRelation"


def _held(field: T.StructField) -> Column:
    """Bytes of a column's values: texts as they are, arrays by their elements, eight for anything else."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(field.dataType, T.ArrayType):
        size = 8 * F.size(column)
    else:
        size = F.lit(8)
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")


def input_bytes(df: DataFrame) -> int:
    """Size of the files below a scan; of anything else (a join, an RDD, a checkpoint) the bytes of its values, measured by one job.

    The planner's own size of a join is a product of its sides, and of an RDD a constant.
    """
    if _is_scan(df):
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    total = F.lit(0).cast("long")
    for i, f in enumerate(df.schema.fields):
        total = total + _held(T.StructField(f"c{i}", f.dataType))
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may repeat
    return int(named.agg(F.sum(total)).first()[0] or 0)


def partitions_for(df: DataFrame, mb: int = 32) -> int:
    """Partitions so that each holds about `mb` MB of the scanned files; at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-input_bytes(df) // (mb << 20)))


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function whose task leaves a small worker behind."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_pair(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for a function of two tables with a key."""

    def wrapped(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        give_back()
        return out

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    if data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a longer row is alone in its range)."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        out.append((start, end))
        start = end
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def pick(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin:begin + size] of each row, one after the other."""
    upto = np.cumsum(size)
    return values[np.repeat(begin - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]


def text_groups(text: pa.Array, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of a string column of at most `most` bytes each."""
    return slices(utf8(text)[1], most)
