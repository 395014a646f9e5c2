"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: no crash, and the stated result."""

import hashlib

import public_tokenizers
import pytest
from odd_rows import LONG, SENTENCE, documents

from tracewright.llm.bpe_codec import encode_decode
from tracewright.llm.decontamination import drop_contaminated, find_contamination
from tracewright.llm.embedding_dedup import near_embeddings
from tracewright.llm.jaccard_join import jaccard_join
from tracewright.llm.language_id import fit_language, identify_language
from tracewright.llm.license_scan import scan_licenses
from tracewright.llm.license_texts import TEXTS
from tracewright.llm.quality import fit_quality, score_quality
from tracewright.llm.suffix_dedup import drop_repeats
from tracewright.llm.token_counts import count_tokens
from tracewright.llm.token_store import store_and_read

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark):
    rows = [(1, SENTENCE), (2, SENTENCE), (3, None), (4, ""), (5, "too short"), (None, "an item without any id at all here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")


OPERATORS = {
    "op1": lambda s, d: find_contamination(d, benchmark(s)),
    "op2": lambda s, d: drop_repeats(d),
    "op3": lambda s, d: count_tokens(d, BYTE),
    "op5": lambda s, d: identify_language(d, fit_language(d)),
    "op6": lambda s, d: store_and_read(d, WORD, 2),
    "op7": lambda s, d: encode_decode(d, WORD, digests=True),
    "op8": lambda s, d: scan_licenses(d),
    "op9": lambda s, d: score_quality(d, fit_quality(d, labels(s))),
    "op10": lambda s, d: jaccard_join(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, spark):
    assert OPERATORS[name](spark, documents(spark, empty=True)).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"op1"}))
def test_every_row_has_an_answer(name, spark):
    docs = documents(spark)
    assert OPERATORS[name](spark, docs).count() == docs.count()


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_contamination(spark):
    found = OPERATORS["op1"](spark, documents(spark)).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    left = drop_contaminated(documents(spark), benchmark(spark))
    assert left.columns == documents(spark).columns and left.count() == documents(spark).count() - 3


def test_suffix_dedup(spark):
    got = by_id(OPERATORS["op2"](spark, documents(spark)))
    size = len(LONG.encode())
    assert (got[7].n_removed, got[8].n_removed, got[8].n_spans) == (got[7].n_removed, size, 1)
    assert got[4].n_bytes == got[5].n_bytes == 0 and got[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[12].n_bytes, got[12].n_removed) == (1600, 1599)
    assert (got[1].n_removed, got[2].n_removed) == (0, 0)  # shorter than the length


def test_language(spark):
    got = by_id(OPERATORS["op5"](spark, documents(spark)))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 10))
    assert got[1].lang_pred != "und" and 0 < got[1].score <= 1


def test_texts_in_no_learned_language_are_not_familiar(spark):
    rows = [(i, SENTENCE + f" number {i}", "en") for i in range(20)] + [(50, "日本語の文章がここにあります。", None), (51, "Это русский текст о погоде", None), (52, "1234", None), (53, None, None), (54, "a fox", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.familiar for r in identify_language(docs, fit_language(docs)).collect()}
    assert [got[i] for i in (0, 19, 50, 51, 52, 53, 54)] == [True, True, False, False, False, False, True]
    got = {r.doc_id: r.familiar for r in identify_language(docs, None).collect()}
    assert [got[i] for i in (0, 50, 52, 53)] == [True, True, False, False]  # nothing learned: a letter is enough


def test_token_files(spark):
    rows = OPERATORS["op6"](spark, documents(spark)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12, None, None]
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert rows[3].n_tokens == 1


def test_licenses(spark):
    got = by_id(OPERATORS["op8"](spark, documents(spark)))
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    text = "Under the MIT License. cc-by-nc CC BY NC. Apache License, Version 2.0"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (15, 4, 0, 10, "apache-2,cc-by-nc,mit")


def test_whole_licences(spark):
    texts = dict([(f"{n}-{label}", text) for n, (label, text, _) in enumerate(TEXTS)])
    mit = texts["0-mit"]
    rows = [(k, "Copyright 2020 Jo Doe\n" + text + " and more") for k, text in texts.items()]
    rows += [("inserted", mit.replace("merge", "merge or join")), ("half", mit[: len(mit) // 3]), ("none", "of the software and of the software in the software")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(k.split("-", 1)[1] in got[k].labels.split(",") and got[k].score == 1 for k in texts)
    assert got["inserted"].labels == "mit" and 0.95 < got["inserted"].score <= 1
    assert got["half"].labels == "mit" and got["none"].labels == ""
    assert got["10-gpl-3"].labels == "gpl-3" and got["5-bsd-3"].labels == "bsd-3"


def test_quality_without_labels(spark):
    assert all(r.score == 0.5 and r.kept for r in OPERATORS["op9"](spark, documents(spark)).collect())


def test_jaccard(spark):
    got = by_id(OPERATORS["op10"](spark, documents(spark)))
    assert (got[1].n_links, got[2].component_id, got[3].component_id, got[2].kept) == (2, 1, 1, False)
    assert got[2].class_id == 1 and got[3].class_id == 3
    assert got[7].n_links == 2 and got[8].component_id == 7
    assert got[4].n_links == got[5].n_links == 0 and got[4].kept and got[5].kept


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, v string")


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [], 1)]
    got = {r.vec_id: r for r in near_embeddings(vectors(spark, [(*r, "x", "y") for r in rows])).collect()}
    assert [got[i].n_links for i in (1, 2, 3)] == [2, 2, 2] and [got[i].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None].n_links == 0 and got[None].kept and len(got) == len(rows)
    assert near_embeddings(vectors(spark, [])).collect() == []


def test_extra_columns_pass_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark).where("doc_id is not null")
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents(spark).columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 4 not in left and 7 in left and 1 not in left and 9 in left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_texts_of_many_megabytes(spark):
    """One text of 6 MB, a copy of its second half, and a short one between them."""
    words = " ".join(f"w{i * 7919 % 100_003} und {i % 311}" for i in range(440_000))
    rows = [(1, words, "en"), (2, SENTENCE, "en"), (3, words[len(words) // 2 :], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    size = [len(r[1]) for r in rows]
    assert size[0] > 6_000_000
    for name in ("op3", "op6", "op7", "op8", "op9", "op10", "op5"):
        assert sorted(r.doc_id for r in OPERATORS[name](spark, docs).collect()) == [1, 2, 3], name
    got = by_id(OPERATORS["op2"](spark, docs))
    assert [got[i].n_bytes for i in (1, 2, 3)] == size and got[2].n_removed == 0 and got[3].n_removed == size[2]
    found = {(r.doc_id, r.item_id) for r in OPERATORS["op1"](spark, docs).collect()}
    assert found == {(2, 1)}
    counts = {name: by_id(OPERATORS[name](spark, docs)) for name in ("op6", "op7")}
    assert all(counts["op6"][i].n_tokens == counts["op7"][i].n_tokens + 1 for i in (1, 2, 3))


def test_token_files_go_once_they_are_read(spark):
    import os

    from tracewright.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = store_and_read(documents(spark), WORD, 2)
    assert rows.count() == documents(spark).count()
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("tracewright-tokens")]
    kept = store_and_read(documents(spark), WORD, 2, keep_files=True)
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert [x for x in set(os.listdir(folder)) - before if x.startswith("tracewright-tokens")]
