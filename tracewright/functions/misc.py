"""Casts, hashes and session functions."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from ..registry import expressions, query

expressions(
    "fn_casts", "part", "p_partkey",
    [
        ("as_bigint", "bigint(p_size)", "p_size::BIGINT"), ("as_int", "int(p_retailprice)", "trunc(p_retailprice)::INT"), ("as_smallint", "smallint(p_size)", "p_size::SMALLINT"), ("as_tinyint", "tinyint(p_size)", "p_size::TINYINT"), ("as_double", "double(p_size)", "p_size::DOUBLE"),
        ("as_float", "float(p_size)", "p_size::FLOAT"), ("as_string", "string(p_size)", "p_size::VARCHAR"), ("as_boolean", "boolean(p_size % 2)", "(p_size % 2)::BOOLEAN"), ("as_date", "string(date('2024-02-03'))", "'2024-02-03'"), ("as_timestamp", "date_format(timestamp('2024-02-03 04:05:06'), 'HH:mm:ss')", "'04:05:06'"),
        ("as_decimal", "string(CAST(p_retailprice AS DECIMAL(12, 2)))", "p_retailprice::DECIMAL(12, 2)::VARCHAR"), ("bad_number", "try_cast(p_brand AS INT)", "try_cast(p_brand AS INT)"), ("decimal_fn", "string(decimal(p_size))", "p_size::VARCHAR"),
    ],
)
expressions(
    "fn_hashes", "nation", "n_nationkey",
    [("md5", "md5(n_name)"), ("sha1", "sha1(n_name)"), ("sha256", "sha2(n_name, 256)", "sha256(n_name)")],
)

_WORDS = [flag + status for flag in "ANR" for status in "FO"]


@query("fn_crc32_sha512", "SELECT word, crc, sha512, count(*) AS n FROM lineitem JOIN (VALUES " + ", ".join(f"('{w}', {zlib.crc32(w.encode())}::BIGINT, '{hashlib.sha512(w.encode()).hexdigest()}')" for w in _WORDS) + ") x(word, crc, sha512) ON word = l_returnflag || l_linestatus GROUP BY ALL")
def fn_crc32_sha512(t):
    """Hashed row by row, then counted; the oracle joins the few known words to their hashes."""
    word = t.lineitem.selectExpr("concat(l_returnflag, l_linestatus) AS word")
    return word.selectExpr("word", "crc32(word) AS crc", "sha2(word, 512) AS sha512").groupBy("word", "crc", "sha512").agg(F.count("*").alias("n"))


_CRC_BIT = "CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"


@query(
    "fn_crc32",
    f"""WITH RECURSIVE step AS (
        SELECT p_partkey, p_name, 0 AS bit, 4294967295::BIGINT AS crc FROM part
        UNION ALL
        SELECT p_partkey, p_name, bit + 1, {_CRC_BIT}
        FROM (SELECT p_partkey, p_name, bit, CASE WHEN bit % 8 = 0 THEN xor(crc, ascii(substr(p_name, bit // 8 + 1, 1))::BIGINT) ELSE crc END AS crc FROM step)
        WHERE bit < 8 * length(p_name))
    SELECT p_partkey, xor(crc, 4294967295) AS crc FROM step WHERE bit = 8 * length(p_name)""",
)
def fn_crc32(t):
    """The oracle divides by the polynomial bit by bit (names are ASCII)."""
    return t.part.selectExpr("p_partkey", "crc32(p_name) AS crc")


@query("fn_murmur_hash", "SELECT count(*) AS n FROM nation")
def fn_murmur_hash(t):
    """The same input hashes alike wherever it is computed."""
    a = t.nation.selectExpr("n_nationkey", "hash(n_name, n_regionkey) AS h")
    b = t.nation.repartition(3).selectExpr("n_nationkey", "hash(n_name, n_regionkey) AS g")
    return a.join(b, "n_nationkey").where("h = g").selectExpr("count(*) AS n")


@query("fn_session", "SELECT true AS db, true AS file, 25 AS ids, true AS parts")
def fn_session(t):
    return t.sql("SELECT max(d) = 'default' AS db, max(f) LIKE '%nation%' AS file, CAST(count(DISTINCT i) AS INT) AS ids, min(p) >= 0 AS parts FROM (SELECT current_database() AS d, input_file_name() AS f, monotonically_increasing_id() AS i, spark_partition_id() AS p FROM nation)")


@query("fn_reflect", "SELECT n_nationkey, n_nationkey::VARCHAR AS a, greatest(n_nationkey, 10)::VARCHAR AS b FROM nation")
def fn_reflect(t):
    return t.nation.selectExpr("n_nationkey", "reflect('java.lang.String', 'valueOf', n_nationkey) AS a", "java_method('java.lang.Math', 'max', n_nationkey, 10) AS b")


@query("fn_assert_true", "SELECT count(*) AS n FROM nation")
def fn_assert_true(t):
    return t.nation.selectExpr("assert_true(n_nationkey >= 0) AS ok").selectExpr("count(*) - count(ok) AS n")


@query("fn_literals", "SELECT p_partkey, p_size + 1 AS i, p_size * 2.5::DOUBLE AS d, p_name || 'it''s' AS s, (p_size > 25) = true AS b, p_size + 255 AS x FROM part")
def fn_literals(t):
    return t.sql("SELECT p_partkey, p_size + 1 AS i, p_size * 2.5D AS d, concat(p_name, 'it\\'s') AS s, (p_size > 25) = true AS b, p_size + CAST(conv('ff', 16, 10) AS INT) AS x FROM part")
