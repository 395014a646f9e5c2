"""Conditional and null functions."""

from __future__ import annotations

from ..registry import expressions

_N = "CASE WHEN p_size > 25 THEN p_size END"

expressions(
    "fn_conditional", "part", "p_partkey",
    [
        ("chosen", "if(p_size > 25, 'big', 'small')", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"), ("cased", "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END"), ("coalesced", f"coalesce({_N}, -1)"), ("ifnulled", f"ifnull({_N}, 0)"), ("nvl1", f"nvl({_N}, 0)", f"coalesce({_N}, 0)"),
        ("nvl22", f"nvl2({_N}, 'y', 'n')", f"CASE WHEN {_N} IS NOT NULL THEN 'y' ELSE 'n' END"), ("nullifed", "nullif(p_size, 10)"), ("nulls", f"isnull({_N})", f"({_N}) IS NULL"), ("not_nulls", f"isnotnull({_N})", f"({_N}) IS NOT NULL"),
        ("nan", "isnan(CAST('NaN' AS DOUBLE))", "true"), ("nanvled", "nanvl(CAST('NaN' AS DOUBLE), p_retailprice)", "p_retailprice"), ("largest", "greatest(p_size, 10, 20)"), ("smallest", "least(p_size, 10, 20)"), ("among", "p_size IN (1, 2, 3)"),
        ("three_valued_and", f"({_N}) > 30 AND p_size > 0"), ("three_valued_or", f"({_N}) > 30 OR p_size > 0"), ("not_null_and", f"NOT (({_N}) > 30)"),
    ],
)
