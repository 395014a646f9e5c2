"""Operator 8: licence scans by diagonal voting, DataFrame functions only.

Words are hashed in rolling 3-grams, all of them are joined with the template
positions (a code constant of a few thousand rows, hence broadcast), and each
hit votes for the diagonal `document position - template position`.  The
template words seen on a diagonal are bits of longs, one long per `BITS` words,
so whole licence texts are templates like any phrase; neighbouring diagonals
(an inserted or lost word shifts by one) are merged by OR-ing their bits, and a
span is verified by the share of the template's words that it covers.  Hash
matches are confirmed on the words themselves before they vote.

Every document also sends one sentinel row through the join, so one scan gives
both the hits and the documents without any.  One shuffle, of hits only.

Defined cases: a null text has no words; a null id stays null; every input row
gives a row, repeated ones too; other columns are not read.  `score` is the
largest share of a template found in the document, 0 if none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import BASE, NOTICES, TEXTS

K = 3
NEAR = 2
BITS = 60
SENTINEL = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def templates() -> list[tuple[int, str, list[str], float, bool]]:
    """(number, label, words, least share, is base)."""
    rows = [(label, text, 1.0, True) for label, text in BASE] + [(*row, False) for row in NOTICES + TEXTS]
    out = [(n, label, re.findall("[0-9a-z]+", text.lower()), least, base) for n, (label, text, least, base) in enumerate(rows)]
    if any(len(words) < K or base and len(words) > BITS for _, _, words, _, base in out):
        raise ValueError(f"a template has {K} words or more, a base phrase at most {BITS}")
    return out


def places() -> list[tuple]:
    """(number, place, block, bits of the words it covers there, gram, words in all, label, least, is base) of all grams."""
    out = []
    for n, label, words, least, base in templates():
        for t in range(len(words) - K + 1):
            for block in sorted({t // BITS, (t + K - 1) // BITS}):
                mask = sum(1 << (w - block * BITS) for w in range(t, t + K) if w // BITS == block)
                out.append((n, t, block, mask, words[t : t + K], len(words), label, least, base))
    return out


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    kinds = "tid int, tpos int, block int, bits long, gram array<string>, t_words int, label string, least double, base boolean"
    table = spark.createDataFrame([*places(), (SENTINEL, 0, 0, 0, [], 0, None, 0.0, False)], kinds)
    key = F.when(F.col("tid") == SENTINEL, 0).otherwise(_hash([F.get("gram", F.lit(i)) for i in range(K)]))
    table = table.withColumn("key", key.cast("long"))

    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")
    rolled = F.transform(
        F.array(F.col("words")),
        lambda w: F.transform(
            F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>")),
            lambda i: _hash([F.get(w, i + j) for j in range(K)]),
        ),
    )[0]
    cut = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words.alias("words"))
    cut = cut.select("uid", "id", "words", F.concat(F.array(F.lit(0).cast("long")), rolled).alias("keys"))
    votes = cut.select("uid", "id", "words", F.posexplode("keys").alias("at", "key")).join(F.broadcast(table), "key")
    same = [F.get("words", F.col("at") - 1 + j) == F.get("gram", F.lit(j)) for j in range(K)]
    sentinel = F.col("tid") == SENTINEL
    votes = votes.where((sentinel & (F.col("at") == 0)) | (~sentinel & (F.col("at") > 0) & same[0] & same[1] & same[2]))
    votes = votes.select(
        "uid", "id", "tid", "block", "t_words", "label", "least", "base", "bits",
        F.when(sentinel, 0).otherwise(F.col("at") - 1 - F.col("tpos")).alias("diagonal"),
        F.when(sentinel, F.size("words")).alias("n_words"),
    ).repartition("uid")

    template = ["uid", "id", "tid", "t_words", "label", "least", "base"]
    lines = votes.groupBy(*template, "diagonal", "block").agg(F.bit_or("bits").alias("bits"), F.max("n_words").alias("n_words"))
    along = Window.partitionBy("uid", "tid").orderBy("diagonal", "block")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    lines = lines.withColumn("span", F.sum(fresh.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.col("base") & (F.bit_count("bits") == F.col("t_words"))
    start = F.when(full, F.col("diagonal"))
    spans = lines.groupBy(*template, "span", "block").agg(
        F.bit_or("bits").alias("bits"), F.max("n_words").alias("n_words"), F.sum(full.cast("long")).alias("n_full"), F.min(start).alias("first"), F.max(start).alias("last")
    )
    spans = spans.groupBy(*template, "span").agg(
        F.sum(F.bit_count("bits")).alias("covered"), F.max("n_words").alias("n_words"), F.sum("n_full").alias("n_full"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    share = F.when(F.col("t_words") > 0, F.col("covered") / F.col("t_words")).otherwise(0.0)
    spans = spans.withColumn("share", share)
    is_base = F.col("n_full") > 0
    noticed = ~F.col("base") & (F.col("t_words") > 0) & (F.col("share") >= F.col("least"))

    def listed(when: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))

    out = spans.groupBy("uid", "id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("n_full").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        listed(is_base).alias("base_labels"), listed(is_base | noticed).alias("labels"), F.max("share").alias("score"),
    )
    return out.drop("uid").withColumnRenamed("id", id_col)


def license_sql() -> str:
    """DuckDB SQL for the same rows over the view `documents`."""
    rows = ", ".join(f"({n}, '{label}', '{' '.join(words)}', {len(words)}, {least}, {str(base).lower()})" for n, label, words, least, base in templates())
    return f"""
WITH t(tid, label, body, t_words, least, base) AS (VALUES {rows}),
places AS (
  SELECT tid, label, t_words, least, base, p AS tpos, array_to_string(string_split(body, ' ')[p + 1 : p + {K}], ' ') AS gram
  FROM t, range(0, t_words - {K - 1}) r(p)),
cut AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
rolled AS (
  SELECT uid, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS gram
  FROM (SELECT uid, words, unnest(range(1, len(words) - {K - 2})) AS pos FROM cut)),
hits AS (
  SELECT uid, tid, label, t_words, least, base, pos - 1 - tpos AS diagonal, tpos + unnest(range({K})) AS word
  FROM rolled JOIN places USING (gram)),
lines AS (
  SELECT uid, tid, label, t_words, least, base, diagonal, list(DISTINCT word) AS seen FROM hits GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER along <= {NEAR} THEN 0 ELSE 1 END AS fresh, base AND len(seen) = t_words AS whole
  FROM lines WINDOW along AS (PARTITION BY uid, tid ORDER BY diagonal)),
spanned AS (
  SELECT *, sum(fresh) OVER (PARTITION BY uid, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
shares AS (
  SELECT uid, tid, label, least, base, span, count(*) FILTER (whole) AS n_full,
         min(diagonal) FILTER (whole) AS first, max(diagonal) FILTER (whole) AS last, len(list_distinct(flatten(list(seen))))::DOUBLE / t_words AS share
  FROM spanned GROUP BY uid, tid, label, t_words, least, base, span),
found AS (
  SELECT uid, sum(n_full) AS n_base, min(first) AS first_word, max(last) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_full > 0)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_full > 0 OR (NOT base AND share >= least))), ',') AS labels,
         max(share) AS score
  FROM shares GROUP BY uid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM cut LEFT JOIN found USING (uid)
"""
