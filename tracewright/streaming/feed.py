"""A stream source of our own: Parquet files that are fed to a folder, with offsets, replay and admission by rate.

The offset is a file's name and a row of it.  Spark's own log says which ranges were
run, so a batch that is planned again reads the same rows, and none is lost or
repeated; how far the source admits rows is kept in a small file beside the feed, and
can only be ahead of that log.  The rate comes from a file that a controller on the
driver rewrites after each batch.

Files are added, never changed, under names that grow.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..registry import query
from ..sources.connectors import folder
from ..sources.tables import Tables
from ..session import workers_find_package


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_small(path: str, value: dict) -> None:
    """A small file, replaced as a whole: written under another name and then moved."""
    system, at = _located(path)
    with system.open_output_stream(f"{at}.new") as out:
        out.write(json.dumps(value).encode())
    system.move(f"{at}.new", at)


def read_small(path: str) -> dict | None:
    system, at = _located(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(at) as file:
        return json.loads(file.read())


class FeedSource(DataSource):
    """Options: path (of the files), state (a folder for how far rows were admitted), rows (a batch's most, 1000), part (rows of a partition, 10000), rate (a rate file), interval (seconds that the rate is for, 1)."""

    @classmethod
    def name(cls) -> str:
        return "tw_feed"

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(schema, dict(self.options))


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.most, self.part = int(options.get("rows", "1000")), int(options.get("part", "10000"))
        self.rate, self.interval = options.get("rate"), float(options.get("interval", "1"))
        self.state = f"{options['state'].rstrip('/')}/admitted.json"
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def _files(self) -> list[tuple[str, int]]:
        """(name, rows) of the files there are, in order; a file's size is read once."""
        system, at = _located(self.path)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))
        for name in names:
            if name not in self.sizes:
                with system.open_input_file(f"{at}/{name}") as file:
                    self.sizes[name] = pq.ParquetFile(file).metadata.num_rows
        return [(name, self.sizes[name]) for name in names]

    def _admit(self) -> int:
        told = read_small(self.rate) if self.rate else None
        return max(1, int(told["rate"] * self.interval)) if told else self.most

    def latestOffset(self) -> dict:
        now = read_small(self.state) or self.initialOffset()
        left = self._admit()
        for name, rows in self._files():
            if left <= 0 or name < now["file"]:
                continue
            begin = now["row"] if name == now["file"] else 0
            taken = min(left, rows - begin)
            if taken > 0:
                now, left = {"file": name, "row": begin + taken}, left - taken
        write_small(self.state, now)
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, rows in self._files():
            low = start["row"] if name == start["file"] else 0
            high = end["row"] if name == end["file"] else rows
            if start["file"] <= name <= end["file"]:
                out += [InputPartition((name, i, min(i + self.part, high))) for i in range(low, high, self.part)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, low, high = partition.value
        target = to_arrow_schema(self.schema)
        system, at = _located(self.path)
        with system.open_input_file(f"{at}/{name}") as handle:
            file, first = pq.ParquetFile(handle), 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                if first < high and first + rows > low:
                    table = file.read_row_group(group, columns=target.names).slice(max(0, low - first), min(high, first + rows) - max(low, first))
                    yield from table.select(target.names).cast(target).to_batches(max_chunksize=1000)
                first += rows

    def commit(self, end: dict) -> None:
        """Nothing to let go: the files stay as long as their owner keeps them."""


@dataclass
class RateController:
    """Rows a second to admit, from what a batch has done: proportional to the gap between the rate and what was
    processed, to the rows that waited meanwhile, and to the gap's change.  The first batch sets the rate."""

    interval: float
    proportional: float = 1.0
    integral: float = 0.2
    derivative: float = 0.0
    least: float = 100.0
    rate: float | None = None
    gap: float = 0.0
    at: float | None = None
    history: list[float] = field(default_factory=list)

    def update(self, at: float, rows: int, seconds: float, waited: float) -> float | None:
        """The rate after a batch that ended at `at`; batches without rows or out of order change nothing."""
        if rows <= 0 or seconds <= 0 or (self.at is not None and at <= self.at):
            return self.rate
        done = rows / seconds
        if self.rate is None:
            self.rate, self.gap = max(self.least, done), 0.0
        else:
            gap, backlog = self.rate - done, waited * done / self.interval
            slope = (gap - self.gap) / (at - self.at)
            self.rate = max(self.least, self.rate - self.proportional * gap - self.integral * backlog - self.derivative * slope)
            self.gap = gap
        self.at = at
        self.history.append(self.rate)
        return self.rate


def controlled(each: Callable[[DataFrame, int], None], controller: RateController, rate_file: str) -> Callable[[DataFrame, int], None]:
    """A batch function whose time and rows set the rate of the feed; `each` runs one action over all its rows."""

    def run(d: DataFrame, i: int) -> None:
        seen = Observation(f"rows_{i}")
        began = time.monotonic()
        each(d.observe(seen, F.count(F.lit(1)).alias("n")), i)
        ended = time.monotonic()
        rate = controller.update(ended, seen.get["n"], ended - began, max(0.0, ended - began - controller.interval))
        if rate is not None:
            write_small(rate_file, {"rate": rate})

    return run


def feed(t: Tables, path: str, columns: str, state: str, **options) -> DataFrame:
    workers_find_package(t.spark)
    t.spark.dataSource.register(FeedSource)
    system, at = _located(state)
    system.create_dir(at)
    reader = t.spark.readStream.format("tw_feed").option("path", path).option("columns", columns).option("state", state)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


EVENTS = "event_id long, event_type string, value double"


def fed_events(t: Tables, files: int = 3) -> str:
    """Events as files of a feed."""
    path = folder(t, "feed")
    t.events.select("event_id", "event_type", "value").repartitionByRange(files, "event_id").write.parquet(path)
    return path


def run_once(t: Tables, rows: DataFrame, each: Callable[[DataFrame, int], None], state: str) -> int:
    """One start of a stream from its checkpoint, one batch, and its end: the rows that came."""
    q = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


@query("stream_feed_restarts", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type")
def stream_feed_restarts(t: Tables) -> DataFrame:
    """A stream that is started anew for every batch loses and repeats nothing."""
    path, state, out = fed_events(t), folder(t, "feed-state"), folder(t, "feed-out")
    most = -(-t.events.count() // 3) + 1

    def keep(d: DataFrame, i: int) -> None:
        d.write.mode("overwrite").parquet(f"{out}/batch={i}")

    while run_once(t, feed(t, path, EVENTS, state, rows=most, part=700), keep, state):
        pass
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
