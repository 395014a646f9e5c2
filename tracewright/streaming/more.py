"""Streaming queries on late rows, triggers and sockets.

The console sink has no query here, as it would print into the output of whoever runs the catalogue.
"""

from __future__ import annotations

import socket
import threading
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.connectors import folder
from ..sources.tables import Tables
from .queries import _ntz, run, sink, stream


def _in_three_batches(t: Tables) -> DataFrame:
    """Events in three batches by their number.  A batch's mark holds for late rows from the second batch after it."""
    path = folder(t, "late")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for rest in (0, 1, 2):
        rows.where(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their time of writing
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


_ON_TIME = "FROM events, (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events WHERE event_id % 3 = 0) WHERE event_id % 3 < 2 OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > mark"


@query("stream_late_rows_dropped", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n {_ON_TIME} GROUP BY 1")
def stream_late_rows_dropped(t: Tables) -> DataFrame:
    """Rows of windows that the watermark has closed come too late and are dropped; the others still count."""
    counts = _in_three_batches(t).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run(t, counts, "update").groupBy("w").agg(F.max("n").alias("n")).select(_ntz("w.start").alias("day"), "n")


@query("stream_late_rows_append", f"SELECT day, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n {_ON_TIME} GROUP BY 1), (SELECT max(ts) - INTERVAL 1 DAY AS last FROM events) WHERE day + INTERVAL 1 DAY <= last")
def stream_late_rows_append(t: Tables) -> DataFrame:
    """Append mode gives each closed window once, without the late rows."""
    counts = _in_three_batches(t).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run(t, counts, "append").select(_ntz("w.start").alias("day"), "n")


@query("stream_late_rows_deduplicate", "SELECT count(DISTINCT event_type) AS kinds FROM events")
def stream_late_rows_deduplicate(t: Tables) -> DataFrame:
    s = _in_three_batches(t).withWatermark("ts", "365 days").select("event_type", "ts").dropDuplicatesWithinWatermark(["event_type"])
    return run(t, s, "append").agg(F.count("*").alias("kinds"))


@query("stream_processing_time_trigger", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_processing_time_trigger(t: Tables) -> DataFrame:
    name = f"tw_{uuid.uuid4().hex[:12]}"
    counts = stream(t).groupBy("event_type").agg(F.count("*").alias("n"))
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", folder(t, "state")).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.table(name)


@query("stream_once_trigger", "SELECT count(*) AS n FROM events")
def stream_once_trigger(t: Tables) -> DataFrame:
    """Everything there is in one batch."""
    path = folder(t, "once")
    q = stream(t).select("event_id").writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(t, "state")).trigger(once=True).start()
    q.awaitTermination()
    if len([p for p in q.recentProgress if p["numInputRows"]]) > 1:
        raise AssertionError("more than one batch")
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("stream_socket", "SELECT n_name AS value FROM nation")
def stream_socket(t: Tables) -> DataFrame:
    """Lines from a socket; the source is for trials, as it cannot be read again after a failure."""
    names = [r.n_name for r in t.nation.select("n_name").collect()]  # 25 rows
    server = socket.create_server(("127.0.0.1", 0))
    server.settimeout(60)
    done = threading.Event()

    def serve() -> None:
        peer, _ = server.accept()
        with peer:
            peer.sendall("".join(n + "\n" for n in names).encode())
            done.wait(60)

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    name = f"tw_{uuid.uuid4().hex[:12]}"
    lines = t.spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load()
    q = lines.writeStream.format("memory").queryName(name).option("checkpointLocation", folder(t, "state")).start()
    try:
        for _ in range(300):
            q.processAllAvailable()
            if t.spark.table(name).count() >= len(names):
                break
            time.sleep(0.1)
    finally:
        q.stop()
        done.set()
        thread.join(5)
        server.close()
    return t.spark.table(name)


@query("stream_glom", "SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events")
def stream_glom(t: Tables) -> DataFrame:
    """The rows of each partition of each batch as one list."""
    path = folder(t, "glom")
    sink(t, stream(t), lambda d, i: d.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("event_id").alias("ids")).write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return t.spark.read.parquet(path).agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
