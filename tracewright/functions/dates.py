"""Date and time functions."""

from __future__ import annotations

from ..registry import expressions, query

_D = "CAST(o_orderdate AS DATE)"

expressions(
    "fn_date_parts", "orders", "o_orderkey",
    [
        ("y", "year(o_orderdate)", "year(o_orderdate)::INT"), ("q", "quarter(o_orderdate)", "quarter(o_orderdate)::INT"), ("m", "month(o_orderdate)", "month(o_orderdate)::INT"), ("d", "day(o_orderdate)", "day(o_orderdate)::INT"), ("dom", "dayofmonth(o_orderdate)", "day(o_orderdate)::INT"),
        ("doy", "dayofyear(o_orderdate)", "dayofyear(o_orderdate)::INT"), ("w", "weekofyear(o_orderdate)", "weekofyear(o_orderdate)::INT"), ("h", "hour(o_orderdate)", "hour(o_orderdate)::INT"), ("mi", "minute(o_orderdate)", "minute(o_orderdate)::INT"), ("s", "second(o_orderdate)", "second(o_orderdate)::INT"),
    ],
)
expressions(
    "fn_date_arithmetic", "orders", "o_orderkey",
    [
        ("added", f"CAST(date_add({_D}, 10) AS STRING)", f"({_D} + 10)::DATE::VARCHAR"), ("taken", f"CAST(date_sub({_D}, 10) AS STRING)", f"({_D} - 10)::DATE::VARCHAR"), ("months", f"CAST(add_months({_D}, 3) AS STRING)", f"({_D} + INTERVAL 3 MONTH)::DATE::VARCHAR"),
        ("apart", f"datediff({_D}, DATE '1992-01-01')", f"date_diff('day', DATE '1992-01-01', {_D})::INT"), ("last", f"CAST(last_day({_D}) AS STRING)", f"last_day({_D})::VARCHAR"),
        ("next_monday", f"CAST(next_day({_D}, 'Mon') AS STRING)", f"({_D} + (7 - (isodow({_D}) + 6) % 7)::INT)::DATE::VARCHAR"), ("between_whole", f"floor(months_between({_D}, DATE '1990-01-01'))", f"CASE WHEN day({_D}) >= 1 THEN date_diff('month', DATE '1990-01-01', {_D}) END"),
        ("first_of_month", f"CAST(trunc({_D}, 'MM') AS STRING)", f"date_trunc('month', {_D})::DATE::VARCHAR"), ("first_of_year", f"CAST(trunc({_D}, 'YEAR') AS STRING)", f"date_trunc('year', {_D})::DATE::VARCHAR"),
        ("formatted", "date_format(o_orderdate, 'yyyy/MM/dd HH:mm')", "strftime(o_orderdate, '%Y/%m/%d %H:%M')"), ("parsed", "CAST(to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS STRING)", f"{_D}::VARCHAR"),
    ],
)
expressions(
    "fn_unix_time", "events", "event_id",
    [
        ("stamp", "unix_timestamp(CAST(ts AS TIMESTAMP))", "floor(epoch(ts))::BIGINT"), ("to_unix", "to_unix_timestamp(CAST(ts AS TIMESTAMP))", "floor(epoch(ts))::BIGINT"), ("back", "from_unixtime(unix_timestamp(CAST(ts AS TIMESTAMP)), 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
        ("tokyo", "date_format(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm')", "strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M')"), ("from_tokyo", "date_format(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm')", "strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M')"),
        ("parsed", "unix_timestamp('2024-03-01 10:20', 'yyyy-MM-dd HH:mm')", "epoch(TIMESTAMP '2024-03-01 10:20:00')::BIGINT"),
    ],
)


@query("fn_current_time", "SELECT o_orderkey, true AS same_day, o_orderdate < now()::TIMESTAMP AS past, date_diff('year', o_orderdate, now()::TIMESTAMP)::INT AS years FROM orders")
def fn_current_time(t):
    """One instant for the whole query: rows are compared with it, whatever task reads them."""
    return t.sql("SELECT o_orderkey, current_date() = to_date(current_timestamp()) AND now() = current_timestamp() AS same_day, o_orderdate < current_timestamp() AS past, year(current_date()) - year(o_orderdate) AS years FROM orders")


@query("fn_interval_literals", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS later FROM orders")
def fn_interval_literals(t):
    return t.sql("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS later FROM orders")
