"""Functions on texts whose results are known from elsewhere."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

WORDS = ["", "a", "spark", "Überfluß"]


def test_hashes_of_texts(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "word string").select("word", F.crc32("word"), F.sha2("word", 512)).collect()
    assert [tuple(r) for r in rows] == [(w, zlib.crc32(w.encode()), hashlib.sha512(w.encode()).hexdigest()) for w in WORDS]


@pytest.mark.parametrize("word, code", [("Robert", "R163"), ("Rupert", "R163"), ("Tymczak", "T522"), ("Pfister", "P236")])
def test_soundex(spark, word, code):
    assert spark.range(1).select(F.soundex(F.lit(word))).first()[0] == code


def test_sentences(spark):
    assert spark.sql("SELECT sentences('Hi there! Good morning.')").first()[0] == [["Hi", "there"], ["Good", "morning"]]


def test_size_and_membership_of_null(spark):
    row = spark.sql("SELECT coalesce(size(CAST(NULL AS ARRAY<INT>)), -1) AS n, array_contains(array(1, NULL), 2) AS unknown, array_contains(array(1, NULL), 1) AS found").first()
    assert tuple(row) == (-1, None, True)
