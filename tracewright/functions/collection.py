"""Arrays, maps and structs."""

from __future__ import annotations

from ..registry import expressions, query

expressions(
    "fn_arrays", "part", "p_partkey",
    [
        ("made", "array(p_size, p_size + 1)", "[p_size, p_size + 1]"), ("has", "array_contains(array(p_size, 10), 10)", "list_contains([p_size, 10], 10)"), ("n", "size(array(1, p_size, 3))", "len([1, p_size, 3])::INT"),
        ("up", "sort_array(array(3, p_size, 1))", "list_sort([3, p_size, 1])"), ("down", "sort_array(array(3, p_size, 1), false)", "list_reverse_sort([3, p_size, 1])"), ("nulls_first", "sort_array(array(2, NULL, p_size))", "list_sort([2, NULL, p_size], 'ASC', 'NULLS FIRST')"),
        ("element", "array(5, p_size)[1]", "[5, p_size][2]"), ("nested", "array(array(p_size), array(1, 2))[1][0]", "1"), ("joined", "concat_ws('+', sort_array(split(lower(p_type), ' ')))", "array_to_string(list_sort(string_split(lower(p_type), ' ')), '+')"),
    ],
)
expressions(
    "fn_maps_structs", "part", "p_partkey",
    [
        ("looked_up", "map('s', p_size, 't', 1)['s']", "p_size"), ("absent", "map('s', p_size)['x']", "NULL::INT"), ("keys", "sort_array(map_keys(map('b', 1, 'a', p_size)))", "['a', 'b']"), ("vals", "sort_array(map_values(map('b', 1, 'a', p_size)))", "list_sort([1, p_size])"),
        ("entries", "size(map('b', 1, 'a', p_size))", "2"), ("field", "named_struct('a', p_size, 'b', p_brand).b", "p_brand"), ("struct_field", "struct(p_size, p_brand).p_size", "p_size"), ("from_text", "str_to_map('a:1,b:2', ',', ':')['b']", "'2'"),
    ],
)


@query("fn_size_of_null", "SELECT doc_id, coalesce(len(CASE WHEN lang IS NOT NULL THEN string_split(text, ' ') END), -1)::INT AS n FROM documents")
def fn_size_of_null(t):
    """The older engine answers -1; said explicitly, it holds under every session setting."""
    return t.sql("SELECT doc_id, coalesce(size(CASE WHEN lang IS NOT NULL THEN split(text, ' ') END), -1) AS n FROM documents")


@query("fn_array_contains_null", "SELECT p_partkey, CASE WHEN p_size = 7 THEN true END AS found, p_size = 7 AS found_without_null FROM part")
def fn_array_contains_null(t):
    """A null among the elements makes a miss unknown."""
    return t.sql("SELECT p_partkey, array_contains(array(p_size, CAST(NULL AS INT)), 7) AS found, array_contains(array(p_size), 7) AS found_without_null FROM part")


@query("fn_embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding)::INT AS width FROM embeddings")
def fn_embedding_norms(t):
    return t.sql("SELECT vec_id, round(sqrt(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm, size(embedding) AS width FROM embeddings")


@query("fn_higher_order", "SELECT p_partkey, list_filter([1, p_size, 20], lambda x: x > 10) AS large, list_transform([1, p_size], lambda x: x * 2) AS doubled FROM part")
def fn_higher_order(t):
    return t.part.selectExpr("p_partkey", "filter(array(1, p_size, 20), x -> x > 10) AS large", "transform(array(1, p_size), x -> x * 2) AS doubled")
