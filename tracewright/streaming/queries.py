"""Structured Streaming queries over `events`, run to the end of the available data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..sources.connectors import folder
from ..sources.tables import Tables


def stream(t: Tables, files: int = 4) -> DataFrame:
    """Events as a stream of files in the order of time."""
    path = folder(t, "events")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(files, "ts").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(t: Tables, df: DataFrame, mode: str) -> DataFrame:
    """Runs to the end of the input into a memory table and returns it."""
    name = f"tw_{uuid.uuid4().hex[:12]}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.table(name)


def sink(t: Tables, df: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@query("stream_map_filter", "SELECT event_id, value * 2 AS v FROM events WHERE value > 90")
def stream_map_filter(t: Tables) -> DataFrame:
    return run(t, stream(t).where("value > 90").select("event_id", (F.col("value") * 2).alias("v")), "append")


@query("stream_flat_map", "SELECT event_id, unnest([event_type, 'all']) AS tag FROM events WHERE value > 95")
def stream_flat_map(t: Tables) -> DataFrame:
    return run(t, stream(t).where("value > 95").select("event_id", F.explode(F.array("event_type", F.lit("all"))).alias("tag")), "append")


@query("stream_complete_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_complete_counts(t: Tables) -> DataFrame:
    return run(t, stream(t).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("stream_update_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_update_counts(t: Tables) -> DataFrame:
    """Update mode emits a key whenever it changes; the last count is the largest."""
    return run(t, stream(t).groupBy("event_type").agg(F.count("*").alias("n")), "update").groupBy("event_type").agg(F.max("n").alias("n"))


@query("stream_tumbling_complete", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling_complete(t: Tables) -> DataFrame:
    return run(t, stream(t).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")), "complete").select(_ntz("w.start").alias("day"), "n")


@query("stream_sliding_complete", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s, event_type FROM events) GROUP BY 1, 2")
def stream_sliding_complete(t: Tables) -> DataFrame:
    return run(t, stream(t).groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n")), "complete").select(_ntz("w.start").alias("start"), "event_type", "n")


@query("stream_watermark_append", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_watermark_append(t: Tables) -> DataFrame:
    """Append mode emits the windows that the watermark has closed."""
    counts = stream(t, files=1).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run(t, counts, "append").select(_ntz("w.start").alias("day"), "n")


@query("stream_deduplicate", "SELECT count(DISTINCT user_id) AS users FROM events")
def stream_deduplicate(t: Tables) -> DataFrame:
    return run(t, stream(t).select("user_id").dropDuplicates(["user_id"]), "append").agg(F.count("*").alias("users"))


@query("stream_union", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def stream_union(t: Tables) -> DataFrame:
    s = stream(t)
    return run(t, s.where("event_type = 'click'").select("event_id").union(s.where("event_type = 'view'").select("event_id")), "append")


@query("stream_static_join", "SELECT e.event_id, k.code FROM events e JOIN (VALUES ('click', 1), ('view', 2)) k(event_type, code) ON e.event_type = k.event_type")
def stream_static_join(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("click", 1), ("view", 2)], "event_type string, code int")
    return run(t, stream(t).join(F.broadcast(kinds), "event_type").select("event_id", "code"), "append")


@query("stream_map_partitions", "SELECT event_id, length(event_type)::BIGINT AS n FROM events WHERE value < 5")
def stream_map_partitions(t: Tables) -> DataFrame:
    def lengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"event_id": p.event_id, "n": p.event_type.str.len()})

    return run(t, stream(t).where("value < 5").mapInPandas(lengths, "event_id long, n long"), "append")


def _keep_total(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, total = state.get if state.exists else (0, 0.0)
    for p in parts:
        count, total = count + len(p), total + float(p.value.sum())
    state.update((count, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [count], "total": [total]})


@query("stream_state_per_key", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state_per_key(t: Tables) -> DataFrame:
    """Keyed state updated batch by batch; the last state of a key has the largest count."""
    states = stream(t).groupBy("user_id").applyInPandasWithState(_keep_total, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
    return run(t, states, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("stream_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_foreach_batch(t: Tables) -> DataFrame:
    """An idempotent sink: a batch's rows replace those an earlier try of it left."""
    path = folder(t, "batches")
    sink(t, stream(t), lambda d, i: d.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_file_sink", "SELECT event_id, event_type FROM events")
def stream_file_sink(t: Tables) -> DataFrame:
    path = folder(t, "sink")
    q = stream(t).select("event_id", "event_type").writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(path)


@query("stream_restart_from_checkpoint", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_restart_from_checkpoint(t: Tables) -> DataFrame:
    """A second run from the same checkpoint takes only what is new: nothing is lost or repeated."""
    source, path, state = folder(t, "source"), folder(t, "out"), folder(t, "state")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))

    def once() -> None:
        s = t.spark.readStream.schema(rows.schema).parquet(source)
        s.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    rows.where("event_id % 2 = 0").write.parquet(source)
    once()
    rows.where("event_id % 2 = 1").write.mode("append").parquet(source)
    once()
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("stream_progress_and_handle", "SELECT true AS named, true AS ended, count(*) AS rows FROM events")
def stream_progress_and_handle(t: Tables) -> DataFrame:
    q = stream(t).writeStream.format("noop").queryName(f"tw_{uuid.uuid4().hex[:8]}").option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = sum(p["numInputRows"] for p in q.recentProgress)
    return t.spark.createDataFrame([(q.name.startswith("tw_"), not q.isActive, rows)], "named boolean, ended boolean, rows long")


@query("stream_windowed_lists", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1")
def stream_windowed_lists(t: Tables) -> DataFrame:
    return run(t, stream(t).groupBy(F.window("ts", "1 day").alias("w")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds")), "complete").select(_ntz("w.start").alias("day"), "kinds")


@query("stream_reduce_by_window", "SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS start, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1")
def stream_reduce_by_window(t: Tables) -> DataFrame:
    return run(t, stream(t).groupBy(F.window("ts", "2 days").alias("w")).agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top")), "complete").select(_ntz("w.start").alias("start"), "total", "top")


@query("stream_rate_source", "SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey < (SELECT count(*) FROM customer) GROUP BY 1")
def stream_rate_source(t: Tables) -> DataFrame:
    """A source that counts, as many rows a batch as there are customers, each joined to the customer of its number."""
    rows = t.customer.count()
    counted = t.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", max(rows, 1)).load().where(F.col("value") < rows)
    met = counted.join(t.customer, F.col("value") == F.col("c_custkey")).select("c_custkey", "c_nationkey")
    path = folder(t, "rate")
    q = met.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(t, "state")).trigger(once=True).start()
    q.awaitTermination()
    return t.spark.read.schema(met.schema).parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))




@query("stream_foreach_rows", "SELECT count(*) AS n FROM events WHERE value > 99")
def stream_foreach_rows(t: Tables) -> DataFrame:
    """A row-wise sink with open, process and close; each partition of a batch leaves one file."""
    path = folder(t, "foreach")
    rows = t.spark.read.parquet(t.path("events")).where("value > 99")

    class Keep:
        def open(self, partition: int, epoch: int) -> bool:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            store.create_dir(base, recursive=True)
            self.file = store.open_output_stream(f"{base}/{epoch}-{partition}.txt")  # the engine closes it
            return True

        def process(self, row) -> None:
            self.file.write(f"{row.event_id}\n".encode())

        def close(self, error) -> None:
            self.file.close()

    if rows.isEmpty():
        return t.spark.createDataFrame([(0,)], "n long")
    q = stream(t).where("value > 99").writeStream.foreach(Keep()).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.text(path).agg(F.count("*").alias("n"))


@query("stream_listener", "SELECT true AS started, true AS ended, count(*) AS rows FROM events")
def stream_listener(t: Tables) -> DataFrame:
    import time

    from pyspark.sql.streaming import StreamingQueryListener

    seen = {"started": False, "ended": False, "rows": 0}

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            seen["started"] = True

        def onQueryProgress(self, event) -> None:
            seen["rows"] += event.progress.numInputRows

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            seen["ended"] = True

    listener = Listener()
    t.spark.streams.addListener(listener)
    try:
        stream(t).writeStream.format("noop").option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # events arrive a moment later
            if seen["ended"]:
                break
            time.sleep(0.1)
    finally:
        t.spark.streams.removeListener(listener)
    return t.spark.createDataFrame([(seen["started"], seen["ended"], seen["rows"])], "started boolean, ended boolean, rows long")


@query("stream_stream_join", "SELECT a.event_id AS click, b.event_id AS view FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts")
def stream_stream_join(t: Tables) -> DataFrame:
    """Two streams joined within an hour; the watermark is wide enough that no row is late."""
    s = stream(t).withWatermark("ts", "60 days")
    a = s.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    b = stream(t).withWatermark("ts", "60 days").where("event_type = 'view'").select(F.col("event_id").alias("view"), "user_id", "ts")
    return run(t, a.join(b, F.expr("u = user_id AND ts >= at - INTERVAL 1 HOUR AND ts <= at")).select("click", "view"), "append")
