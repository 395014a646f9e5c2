"""Debugger queries on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables
from .debugger import DebugSession, guarded, latency_summary, profiled, slowest, stragglers, watchpoint
from .provenance import TracedFrame



def _code(record: dict) -> int:
    """Fails for every kind of event that has no code."""
    return {"signup": 1, "purchase": 2, "view": 3, "click": 4}[record["event_type"]]


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value")


def _coded(t: Tables):
    return guarded(_events(t), _code, "long", "event_id")


_CODED = "SELECT event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 END::BIGINT AS value FROM events WHERE event_type <> 'error'"


@query("debug_watchpoint_flow", "SELECT count(*) AS n FROM events")
def debug_watchpoint_flow(t: Tables) -> DataFrame:
    return watchpoint(_events(t), "value > 95")[0].agg(F.count("*").alias("n"))


@query("debug_watchpoint_captured", "SELECT event_id FROM events WHERE value > 95")
def debug_watchpoint_captured(t: Tables) -> DataFrame:
    return watchpoint(_events(t), "value > 95")[1].captured().select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


@query("debug_watchpoint_new_guard", "SELECT event_id FROM events WHERE event_type = 'error' AND value < 10")
def debug_watchpoint_new_guard(t: Tables) -> DataFrame:
    w = watchpoint(_events(t), "value > 95")[1]
    w.replace("event_type = 'error' AND value < 10")
    return w.captured().select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


@query("debug_watchpoint_view", "SELECT 10 AS n")
def debug_watchpoint_view(t: Tables) -> DataFrame:
    return watchpoint(_events(t), "value > 1")[1].view().agg(F.count("*").cast("int").alias("n"))


@query("debug_crash_skip", _CODED)
def debug_crash_skip(t: Tables) -> DataFrame:
    return _coded(t).skip().select("event_id", F.col("result").alias("value"))


@query("debug_crash_quarantine", "SELECT event_id AS rid, user_id, 'KeyError: ''error''' AS error FROM events WHERE event_type = 'error'")
def debug_crash_quarantine(t: Tables) -> DataFrame:
    return _coded(t).quarantine.select("rid", F.col("record.user_id").alias("user_id"), "error")


@query("debug_crash_modify", _CODED + " UNION ALL SELECT event_id, 3 FROM events WHERE event_type = 'error'")
def debug_crash_modify(t: Tables) -> DataFrame:
    return _coded(t).modify({"event_type": F.lit("view")}).select("event_id", F.col("result").alias("value"))


@query("debug_crash_lazy_modify", _CODED + " UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'error'")
def debug_crash_lazy_modify(t: Tables) -> DataFrame:
    g = _coded(t)
    repaired = g.quarantine.select("record.*").withColumn("event_type", F.lit("signup"))
    return g.lazy_modify(repaired, limit=1_000_000_000).select("event_id", F.col("result").alias("value"))


@query("debug_crash_lazy_one_repair", _CODED + " UNION ALL SELECT event_id, 4 FROM events WHERE event_type = 'error'")
def debug_crash_lazy_one_repair(t: Tables) -> DataFrame:
    return _coded(t).lazy_modify_all({"event_type": F.regexp_replace("event_type", "error", "click")}).select("event_id", F.col("result").alias("value"))


@query("debug_live_fix", _CODED + " UNION ALL SELECT event_id, 0 FROM events WHERE event_type = 'error'")
def debug_live_fix(t: Tables) -> DataFrame:
    return _coded(t).fix(lambda r: 0).ok.select("event_id", F.col("result").alias("value"))


@query("debug_resolve_one", "SELECT count(*) AS failed FROM events WHERE event_type = 'error' AND event_id <> (SELECT min(event_id) FROM events WHERE event_type = 'error')")
def debug_resolve_one(t: Tables) -> DataFrame:
    g = _coded(t)
    first = t.events.where("event_type = 'error'").agg(F.min("event_id")).first()[0]
    return g.resolve(first, "modify", {"event_type": F.lit("view")}).quarantine.agg(F.count("*").alias("failed"))


@query("debug_crash_filter", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'view', 'click')")
def debug_crash_filter(t: Tables) -> DataFrame:
    return guarded(_events(t), lambda r: {"signup": 1, "purchase": 2, "view": 3, "click": 4}[r["event_type"]] > 1, "boolean", "event_id", "filter").skip().select("event_id")


@query("debug_crash_flat_map", "SELECT event_id, unnest(CASE event_type WHEN 'signup' THEN [0] WHEN 'purchase' THEN [0, 1] WHEN 'view' THEN [0, 1, 2] WHEN 'click' THEN [0, 1, 2, 3] END)::BIGINT AS value FROM events WHERE event_type <> 'error'")
def debug_crash_flat_map(t: Tables) -> DataFrame:
    return guarded(_events(t), lambda r: list(range({"signup": 1, "purchase": 2, "view": 3, "click": 4}[r["event_type"]])), "array<long>", "event_id", "flat_map").skip().select("event_id", F.col("result").alias("value"))


@query("debug_crash_builtin_try", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events")
def debug_crash_builtin_try(t: Tables) -> DataFrame:
    """Built-in expressions need no Python: the try_ functions give null instead of failing."""
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return t.events.select(text.try_cast("long").alias("y")).agg(F.count("*").alias("n"), F.count(F.when(F.col("y").isNull(), 1)).alias("bad"))


@query("debug_crash_trace_to_source", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3) GROUP BY user_id")
def debug_crash_trace_to_source(t: Tables) -> DataFrame:
    """A failing group leads back to all the source records behind it."""
    source = TracedFrame.source(_events(t), ["event_id"])
    users = source.group_by(["user_id"], F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    failed = guarded(users.data, lambda r: 1 // (0 if r["errors"] >= 3 else 1), "long", "user_id").quarantine.select(F.col("rid").alias("user_id"))
    at = users.lineage()
    chosen = users.df.join(failed, "user_id", "left_semi").select(F.col("__rid").alias("id"))
    at.ids = at.ids.join(chosen, "id", "left_semi")
    return at.go_back().dump().groupBy("user_id").agg(F.count("*").alias("n"))


@query("debug_profile_summary", "SELECT 'code' AS op, count(*) AS records, true AS timed FROM events WHERE event_type <> 'error'")
def debug_profile_summary(t: Tables) -> DataFrame:
    p = profiled(_events(t).where("event_type <> 'error'"), _code, "long", "code", "event_id")
    return latency_summary(p).select("op", "records", ((F.col("mean_ms") >= 0) & (F.col("std_ms") >= 0)).alias("timed"))


@query("debug_profile_slowest", "SELECT 10 AS n")
def debug_profile_slowest(t: Tables) -> DataFrame:
    return slowest(profiled(_events(t), lambda r: len(r["event_type"]), "long", "length", "event_id")).agg(F.count("*").cast("int").alias("n"))


@query("debug_profile_stragglers", "SELECT true AS few")
def debug_profile_stragglers(t: Tables) -> DataFrame:
    """By Chebyshev at most a quarter of the records lie two deviations above the mean."""
    from .storage import reliable

    p = reliable(profiled(_events(t), lambda r: len(r["event_type"]), "long", "length", "event_id"))
    return stragglers(p).agg(F.count("*").alias("s")).join(p.agg(F.count("*").alias("n"))).select((F.col("s") <= F.col("n") / 4).alias("few"))


def _session(t: Tables) -> DebugSession:
    stages = [("filter", lambda d: d.where("value > 10")), ("double", lambda d: d.withColumn("value", F.col("value") * 2)), ("count", lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")))]
    return DebugSession(_events(t), stages)


@query("debug_breakpoint_resume", "SELECT event_type, count(*) AS n, round(sum(value * 2), 3) AS total FROM events WHERE value > 10 GROUP BY event_type")
def debug_breakpoint_resume(t: Tables) -> DataFrame:
    s = _session(t)
    s.breakpoint("count")
    s.resume()
    return s.resume()


@query("debug_step_and_replace", "SELECT event_type, count(*) AS n, round(sum(value * 3), 3) AS total FROM events WHERE value > 10 GROUP BY event_type")
def debug_step_and_replace(t: Tables) -> DataFrame:
    s = _session(t)
    s.step()
    s.replace("double", lambda d: d.withColumn("value", F.col("value") * 3))
    return s.resume()
