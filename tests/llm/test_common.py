"""Input sizes and what a run leaves behind."""

import os

import public_tokenizers
from odd_rows import SENTENCE, documents

from tracewright.llm.common import input_bytes, partitions_for, shared_folder
from tracewright.llm.embedding_dedup import near_embeddings
from tracewright.llm.suffix_dedup import drop_repeats
from tracewright.llm.token_store import store_and_read

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_sizes_are_those_of_the_input(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    documents(spark).select("doc_id", "text").write.parquet(path)
    scan = spark.read.parquet(path)
    text = sum(len((r.text or "").encode()) for r in scan.collect())
    files = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    assert input_bytes(scan) == input_bytes(scan.where("doc_id > 0")) == files
    small = spark.range(20).withColumnRenamed("id", "doc_id")
    joined = scan.join(small, "doc_id").join(small, "doc_id")
    known = sum(len((r.text or "").encode()) + 8 for r in scan.collect() if r.doc_id is not None)
    assert input_bytes(joined) == known
    rdd = spark.createDataFrame(scan.rdd, scan.schema)
    assert input_bytes(rdd) == text + 8 * scan.count()
    assert input_bytes(scan.where("false").repartition(2)) == 0
    assert partitions_for(joined.crossJoin(spark.range(2)), 4) == 4  # the session's shuffle partitions


def test_operators_on_joined_and_on_rdd_backed_tables(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    rows = [(i, f"{SENTENCE} {SENTENCE} {i % 7}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    scan = spark.read.parquet(path)
    others = [scan.join(spark.range(30).withColumnRenamed("id", "doc_id"), "doc_id"), spark.createDataFrame(scan.rdd, scan.schema)]
    for run in (drop_repeats, lambda d: store_and_read(d, WORD, 2)):
        want = sorted(map(str, run(scan).collect()))
        assert all(sorted(map(str, run(d).collect())) == want for d in others)
    vectors = spark.createDataFrame([(i, [1.0, i % 5 / 10, 0.0], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "v.parquet"))
    scan = spark.read.parquet(str(tmp_path / "v.parquet"))
    assert sorted(map(str, near_embeddings(scan).collect())) == sorted(map(str, near_embeddings(spark.createDataFrame(scan.rdd, scan.schema)).collect()))


def test_a_run_leaves_its_last_table_only(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"{SENTENCE} {i % 3}", "en", "a", 90) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that no text here holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = shared_folder(spark).removeprefix("file://")

    def left():
        names = {x for x in os.listdir(folder) if x.startswith("tracewright-")}
        return names | {f"{d}/{x}" for d in os.listdir(folder) if os.path.isdir(f"{folder}/{d}") for x in os.listdir(f"{folder}/{d}") if x.startswith("rdd-")}

    input_bytes(docs)
    before = left() if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stays = left() - before
    assert rows and [x.split("-")[1] for x in stays] == ["decontamination"], stays


def test_pipeline_on_an_empty_table_and_on_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    item = [(1, "an item that no text here holds at all")]
    for name, empty in (("empty", True), ("odd", False)):
        documents(spark, empty=empty).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(item, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (rows == []) is empty
