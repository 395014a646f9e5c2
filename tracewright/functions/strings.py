"""String functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import expressions, query

expressions(
    "fn_string_basic", "part", "p_partkey",
    [
        ("ascii", "ascii(p_name)"), ("base64", "base64(encode(p_brand, 'UTF-8'))", "base64(encode(p_brand))"), ("unbase64", "CAST(unbase64(base64(encode(p_brand, 'UTF-8'))) AS STRING)", "p_brand"),
        ("concat", "concat(p_brand, '/', p_type)", "p_brand || '/' || p_type"), ("concat_ws", "concat_ws('-', p_brand, NULL, p_type)"), ("decode", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"),
        ("elt", "elt(p_size % 2 + 1, p_brand, p_type)", "CASE p_size % 2 WHEN 0 THEN p_brand ELSE p_type END"), ("initcap", "initcap(lower(p_type))", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"),
        ("instr", "instr(p_name, 'a')", "instr(p_name, 'a')::INT"), ("length", "length(p_name)", "length(p_name)::INT"), ("lower", "lower(p_name)"), ("lcase", "lcase(p_name)"), ("upper", "upper(p_name)"), ("ucase", "ucase(p_name)"),
        ("locate", "locate('e', p_name)", "instr(p_name, 'e')::INT"), ("locate_from", "locate('e', p_name, 4)", "CASE WHEN instr(substr(p_name, 4), 'e') = 0 THEN 0 ELSE (instr(substr(p_name, 4), 'e') + 3)::INT END"),
        ("position", "position('e' IN p_name)", "position('e' IN p_name)::INT"), ("lpad", "lpad(p_brand, 12, '*')"), ("rpad", "rpad(p_brand, 12, '*')"), ("lpad_cut", "lpad(p_type, 3, ' ')"), ("ltrim", "ltrim(concat('  ', p_brand, ' '))"), ("rtrim", "rtrim(concat('  ', p_brand, ' '))"), ("trim", "trim(concat('  ', p_brand, ' '))"),
        ("repeat", "repeat(p_brand, 2)"), ("reverse", "reverse(p_name)"), ("space", "concat(space(3), '|')", "repeat(' ', 3) || '|'"), ("substr", "substr(p_name, 2, 3)"), ("substring", "substring(p_name, 3)"), ("substring_tail", "substring(p_name, -3, 2)"),
        ("translate", "translate(p_name, 'aeiou', '12345')"),
    ],
)
expressions(
    "fn_string_search", "part", "p_partkey",
    [
        ("find_in_set", "find_in_set(CAST(p_size AS STRING), '1,5,10,15,20')", "coalesce(list_position(['1', '5', '10', '15', '20'], p_size::VARCHAR), 0)"), ("levenshtein", "levenshtein(p_brand, p_type)", "levenshtein(p_brand, p_type)::INT"),
        ("likes", "p_name LIKE '%a_%'"), ("rlikes", "p_name RLIKE '^[a-m]'", "regexp_matches(p_name, '^[a-m]')"), ("regexp_extract", "regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2)", "regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2)"),
        ("regexp_replace", "regexp_replace(p_brand, '[0-9]+', 'N')", "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"), ("split_first", "split(p_type, ' ')[0]", "string_split(p_type, ' ')[1]"), ("split_size", "size(split(p_name, ' '))", "len(string_split(p_name, ' '))::INT"),
        ("substring_index", "substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]"), ("starts", "startswith(p_name, 'P')", "starts_with(p_name, 'P')"), ("ends", "endswith(p_name, '1')", "suffix(p_name, '1')"),
        ("format_string", "format_string('%s-%05d', p_brand, p_size)", "printf('%s-%05d', p_brand, p_size)"), ("printf", "printf('%d|%s', p_size, p_brand)"), ("format_number", "format_number(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"),
    ],
)


# the digit of each letter, 0 for vowels; H and W leave no trace between equal digits
_DIGITS = "translate(upper({}), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '000000111122222222334556')"
_RUNS = _DIGITS.format("word")
for _digit in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_digit}+', '{_digit}', 'g')"


@query("fn_soundex", f"SELECT word, upper(word[1]) || left(replace(substr({_RUNS}, CASE WHEN upper(word[1]) IN ('H', 'W') THEN 1 ELSE 2 END), '0', '') || '000', 3) AS code, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word)")
def fn_soundex(t):
    """Every word of the documents, however often it occurs, by its sound."""
    words = t.documents.select(F.explode(F.expr("regexp_extract_all(text, '[A-Za-z]+', 0)")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", F.soundex("word").alias("code"), "n")


@query("fn_sentences", "SELECT p_partkey, 2 AS n, 'The' AS first_word, len(string_split(p_name, ' '))::INT + 7 AS words, p_size::VARCHAR AS last_word FROM part")
def fn_sentences(t):
    """Two sentences on every part, taken apart into words."""
    told = t.part.selectExpr("p_partkey", "sentences(concat('The part is ', p_name, '. Its size is ', p_size, '!')) AS s")
    return told.selectExpr("p_partkey", "size(s) AS n", "s[0][0] AS first_word", "size(flatten(s)) AS words", "element_at(s[1], -1) AS last_word")


expressions(
    "fn_parse_url", "pages", "page_id",
    [
        ("host", "parse_url(url, 'HOST')", "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"), ("scheme", "parse_url(url, 'PROTOCOL')", "regexp_extract(url, '^([a-z]+)://', 1)"),
        ("query_part", "parse_url(url, 'QUERY')", "nullif(regexp_extract(url, '\\?([^#]*)', 1), '')"), ("fragment", "parse_url(url, 'REF')", "nullif(regexp_extract(url, '#(.*)$', 1), '')"),
    ],
)
