"""JSON and XML functions."""

from __future__ import annotations

from ..registry import expressions, query

expressions("fn_json_path", "events", "event_id", [("k", "get_json_object(props, '$.k')", "props::JSON ->> '$.k'"), ("absent", "get_json_object(props, '$.none')", "props::JSON ->> '$.none'")])


@query("fn_json_tuple", "SELECT event_id, props::JSON ->> '$.k' AS k, NULL::VARCHAR AS missing FROM events")
def fn_json_tuple(t):
    return t.sql("SELECT event_id, k, missing FROM events LATERAL VIEW json_tuple(props, 'k', 'zz') x AS k, missing")


@query("fn_from_json", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def fn_from_json(t):
    return t.events.selectExpr("event_id", "from_json(props, 'k INT').k AS k")


@query("fn_from_json_malformed", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (props::JSON ->> 'k')::INT END AS k FROM events")
def fn_from_json_malformed(t):
    """Texts cut off in the middle give nulls, the others their value."""
    return t.sql("SELECT event_id, from_json(CASE WHEN event_id % 3 = 0 THEN substr(props, 1, 4) ELSE props END, 'k INT').k AS k FROM events")


@query("fn_to_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","k":' || n_regionkey || '}' AS doc FROM nation""")
def fn_to_json(t):
    return t.nation.selectExpr("n_nationkey", "to_json(struct(n_name, n_regionkey AS k)) AS doc")


@query("fn_xpath", "SELECT n_nationkey, n_name AS s, n_regionkey::INT AS i, n_regionkey::BIGINT AS l, n_regionkey::SMALLINT AS sh, n_regionkey::DOUBLE AS d, n_regionkey::FLOAT AS f, n_regionkey::DOUBLE AS num, true AS b, [n_name] AS all_names FROM nation")
def fn_xpath(t):
    rows = t.nation.selectExpr("n_nationkey", "concat('<a><n>', n_name, '</n><k>', n_regionkey, '</k></a>') AS x")
    return rows.selectExpr(
        "n_nationkey", "xpath_string(x, 'a/n') AS s", "xpath_int(x, 'a/k') AS i", "xpath_long(x, 'a/k') AS l", "xpath_short(x, 'a/k') AS sh", "xpath_double(x, 'a/k') AS d", "xpath_float(x, 'a/k') AS f",
        "xpath_number(x, 'a/k') AS num", "xpath_boolean(x, 'a/n') AS b", "xpath(x, 'a/n/text()') AS all_names",
    )
