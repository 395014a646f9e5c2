"""Provenance queries: traces back, forward, and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import Tables
from .provenance import RID, TracedFrame
from .storage import scratch

_SPLIT = "string_split(lower(text), ' ')"


def word_count(t: Tables) -> tuple[TracedFrame, TracedFrame]:
    docs = TracedFrame.source(t.documents.select("doc_id", "text"), ["doc_id"])
    words = docs.flat_map("word", F.split(F.lower("text"), " ")).select("doc_id", "word")
    return docs, words.group_by(["word"], F.count("*").alias("n"))


@query("prov_word_count", f"SELECT word, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS word FROM documents) GROUP BY word")
def prov_word_count(t: Tables) -> DataFrame:
    return word_count(t)[1].data


@query("prov_back_from_group", f"SELECT doc_id FROM documents WHERE list_contains({_SPLIT}, 'license.')")
def prov_back_from_group(t: Tables) -> DataFrame:
    """Which documents made a group of the word count."""
    return word_count(t)[1].lineage().where(F.col("word") == "license.").go_back_all().show().select("doc_id")


@query("prov_back_one_step", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT}) AS word FROM documents) WHERE word = 'license.' GROUP BY doc_id")
def prov_back_one_step(t: Tables) -> DataFrame:
    return word_count(t)[1].lineage().where(F.col("word") == "license.").go_back().dump().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("prov_forward", f"WITH w AS (SELECT doc_id, unnest({_SPLIT}) AS word FROM documents), hit AS (SELECT DISTINCT doc_id FROM w WHERE word = 'license.') SELECT word, count(*) AS n FROM w WHERE word IN (SELECT word FROM w JOIN hit USING (doc_id)) GROUP BY word")
def prov_forward(t: Tables) -> DataFrame:
    """Back to the documents of a group, then forward to every group they influenced."""
    at = word_count(t)[1].lineage().where(F.col("word") == "license.").go_back_all()
    return at.go_next().go_next().show()


@query("prov_show_filter", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'license.') AND n_chars > 500")
def prov_show_filter(t: Tables) -> DataFrame:
    at = word_count(t)[1].lineage().where(F.col("word") == "license.").go_back_all()
    return at.where(F.length("text") > 500).show().select("doc_id")


@query("prov_replay_group", f"SELECT word, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS word FROM documents) WHERE word = 'license.' GROUP BY word")
def prov_replay_group(t: Tables) -> DataFrame:
    """Replaying only the traced documents gives the group again."""
    docs, counts = word_count(t)
    rows = counts.lineage().where(F.col("word") == "license.").go_back_all().dump()
    return counts.replay(docs, rows).where(F.col("word") == "license.")


_LENGTHS = "SELECT substr(word, 1, 1) AS letter, avg(length(word)) AS mean FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1"


@query("prov_average_length_fault", f"WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), f AS ({_LENGTHS}) SELECT DISTINCT w.doc_id, w.word FROM w JOIN f ON substr(w.word, 1, 1) = f.letter WHERE f.mean > 12 AND w.word <> ''")
def prov_average_length_fault(t: Tables) -> DataFrame:
    """Average word length by first letter; the records behind averages that look wrong."""
    docs = TracedFrame.source(t.documents.select("doc_id", "text"), ["doc_id"])
    words = docs.flat_map("word", F.split("text", " ")).select("doc_id", "word").where("word <> ''").with_column("letter", F.substring("word", 1, 1))
    means = words.group_by(["letter"], F.avg(F.length("word")).alias("mean"))
    return means.lineage().where("mean > 12").go_back().dump().select("doc_id", "word").distinct()


def _sales(t: Tables) -> tuple[TracedFrame, TracedFrame, TracedFrame]:
    customers = TracedFrame.source(t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"])
    orders = TracedFrame.source(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice"), ["o_orderkey"])
    both = orders.join(customers, ["c_custkey"])
    return customers, orders, both.group_by(["c_nationkey"], F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("prov_join_left_side", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def prov_join_left_side(t: Tables) -> DataFrame:
    return _sales(t)[2].lineage().where("c_nationkey = 7").go_back().go_back(0).show().select("o_orderkey")


@query("prov_join_right_side", "SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7")
def prov_join_right_side(t: Tables) -> DataFrame:
    return _sales(t)[2].lineage().where("c_nationkey = 7").go_back().go_back(1).show().select("c_custkey")


@query("prov_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS inputs FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10 GROUP BY ALL")
def prov_aggregate(t: Tables) -> DataFrame:
    """Inputs of a summary's groups; lines have no unique key, so their file position names them."""
    lines = TracedFrame.source(t.lineitem).where("l_quantity > 10")
    summary = lines.group_by(["l_returnflag", "l_linestatus"], F.sum("l_quantity").alias("q"))
    return summary.lineage().where("l_returnflag = 'A'").go_back().dump().groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("inputs"))


@query("prov_union_distinct", "SELECT n_name AS name FROM nation WHERE n_name LIKE 'A%' UNION ALL SELECT r_name FROM region WHERE r_name LIKE 'A%'")
def prov_union_distinct(t: Tables) -> DataFrame:
    nations = TracedFrame.source(t.nation.select("n_nationkey", F.col("n_name").alias("name")), ["n_nationkey"]).select("name")
    regions = TracedFrame.source(t.region.select("r_regionkey", F.col("r_name").alias("name")), ["r_regionkey"]).select("name")
    at = nations.union(regions).distinct().lineage().where("name like 'A%'").go_back()
    return at.go_back(0).dump().select("name").unionByName(at.go_back(1).dump().select("name"))


@query("prov_cogroup", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def prov_cogroup(t: Tables) -> DataFrame:
    a = TracedFrame.source(t.customer.select("c_custkey", F.col("c_nationkey").alias("k")), ["c_custkey"])
    b = TracedFrame.source(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k")), ["s_suppkey"])
    both = a.cogroup(b, ["k"], F.count("*").alias("customers"), F.count("*").alias("suppliers"))
    return both.lineage().where("k = 3").go_back(0).show().select("c_custkey")


@query("prov_zip_partitions", "SELECT n_nationkey, n_name, n_regionkey AS r FROM nation WHERE n_regionkey = 2")
def prov_zip_partitions(t: Tables) -> DataFrame:
    """The i-th record of a bucket meets the i-th of the other side's, here its own other half; the pairs lead back to both."""
    a = TracedFrame.source(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    b = TracedFrame.source(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")), ["k"])
    at = a.zip_partitions(b, 3, "n_nationkey", "k").lineage().where("r = 2")
    left, right = at.go_back(0).show().select("n_nationkey", "n_name"), at.go_back(1).show().select("k", "r")
    return left.join(right, F.col("n_nationkey") == F.col("k")).drop("k")


@query("prov_zip_three", "SELECT n_nationkey, n_name, n_regionkey AS r, length(n_name) AS c FROM nation WHERE n_nationkey > 4")
def prov_zip_three(t: Tables) -> DataFrame:
    sides = [TracedFrame.source(t.nation.selectExpr(*columns), [columns[0].split()[-1]]) for columns in (("n_nationkey", "n_name"), ("n_nationkey AS k", "n_regionkey AS r"), ("n_nationkey AS j", "length(n_name) AS c"))]
    at = sides[0].zip_three(sides[1], sides[2], 4, ("n_nationkey", "k", "j")).lineage().where("k > 4")
    pairs = at.go_back(0)
    first, second, third = pairs.go_back(0).show(), pairs.go_back(1).show(), at.go_back(1).show()
    return first.join(second, F.col("n_nationkey") == F.col("k")).join(third, F.col("k") == F.col("j")).select("n_nationkey", "n_name", "r", "c")


@query("prov_text_files", "SELECT n_name AS value FROM nation WHERE n_name LIKE 'I%' UNION ALL SELECT n_name FROM nation WHERE n_name LIKE 'I%'")
def prov_text_files(t: Tables) -> DataFrame:
    """Lines of text files of equal names in two folders: each line is a record of its own, numbered once."""
    folder = scratch(t.spark, "prov-text")
    for part in ("a", "b"):
        t.nation.select(F.col("n_name").alias("value")).coalesce(1).write.text(f"{folder}/part={part}")
    lines = TracedFrame.source(t.spark.read.text(f"{folder}/part=*"))
    counts = lines.flat_map("letter", F.array(F.substring("value", 1, 1))).group_by(["letter"], F.count("*").alias("n"))
    return counts.lineage().where("letter = 'I'").go_back_all().dump().select("value")


@query("prov_equal_file_names", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def prov_equal_file_names(t: Tables) -> DataFrame:
    """Files of one name in two folders hold different records."""
    folder = scratch(t.spark, "prov-names")
    rows = t.region.select("r_regionkey", "r_name").coalesce(1)
    rows.write.parquet(f"{folder}/one")
    rows.write.parquet(f"{folder}/two")
    both = TracedFrame.source(t.spark.read.parquet(f"{folder}/one", f"{folder}/two"))
    return both.df.dropDuplicates([RID]).drop(RID)


@query("prov_union_keys", "SELECT ts::VARCHAR AS ts, k FROM (VALUES (TIMESTAMP '2024-01-01 00:00:00.000001', 1), (TIMESTAMP '2024-01-01 00:00:00.000002', 2), (NULL, 3)) x(ts, k) WHERE k <> 1 UNION ALL SELECT r_name, r_regionkey::INT FROM region WHERE r_regionkey > 1")
def prov_union_keys(t: Tables) -> DataFrame:
    """Keys of either branch keep their type and precision; a null key is a key."""
    stamps = t.spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', 1), (TIMESTAMP_NTZ '2024-01-01 00:00:00.000002', 2), (CAST(NULL AS TIMESTAMP_NTZ), 3) x(ts, k)")
    a = TracedFrame.source(stamps, ["ts"]).with_column("ts", F.col("ts").cast("string"))
    b = TracedFrame.source(t.region.select(F.col("r_name").alias("ts"), F.col("r_regionkey").cast("int").alias("k")), ["k"])
    return a.union(b).lineage().where("k > 1").dump().select("ts", "k")


@query("prov_sorted_and_repartitioned", "SELECT n_nationkey FROM nation WHERE n_regionkey = 3")
def prov_sorted_and_repartitioned(t: Tables) -> DataFrame:
    """Sorting, coalescing and repartitioning move records and keep their ids."""
    nations = TracedFrame.source(t.nation, ["n_nationkey"]).order_by("n_name").coalesce(2).repartition_and_sort(3, "n_regionkey")
    return nations.group_by(["n_regionkey"], F.count("*").alias("n")).lineage().where("n_regionkey = 3").go_back().show().select("n_nationkey")


@query("prov_materialised_edges", "SELECT c_custkey FROM customer WHERE c_nationkey = 5")
def prov_materialised_edges(t: Tables) -> DataFrame:
    """Edges are written once; the walk reads them."""
    groups = TracedFrame.source(t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"]).group_by(["c_nationkey"], F.count("*").alias("n")).materialise()
    return groups.lineage().where("c_nationkey = 5").go_back().show().select("c_custkey")


@query("prov_get_aggregate", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey = 5 GROUP BY 1")
def prov_get_aggregate(t: Tables) -> DataFrame:
    groups = TracedFrame.source(t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"]).group_by(["c_nationkey"], F.count("*").alias("n"))
    return groups.aggregate(c_nationkey=5)


@query("prov_background_edges", "SELECT c_custkey, 3 AS walks FROM customer WHERE c_nationkey = 5")
def prov_background_edges(t: Tables) -> DataFrame:
    """The same walk before, while and after the edges are written."""
    groups = TracedFrame.source(t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"]).group_by(["c_nationkey"], F.count("*").alias("n"))

    def walk() -> DataFrame:
        return groups.lineage().where("c_nationkey = 5").go_back().show().select("c_custkey")

    walks = [walk()]
    written = groups.materialise_in_background()
    walks.append(walk())
    written.result()
    walks.append(walk())
    return walks[0].unionByName(walks[1]).unionByName(walks[2]).groupBy("c_custkey").agg(F.count("*").cast("int").alias("walks"))


@query("prov_collection_source", "SELECT n_name AS line FROM nation WHERE n_name LIKE 'I%'")
def prov_collection_source(t: Tables) -> DataFrame:
    """Rows that the driver holds (25 of them) are numbered and traced like any others."""
    lines = TracedFrame.source(t.spark.createDataFrame([(r.n_name,) for r in t.nation.select("n_name").collect()], "line string"))
    counts = lines.flat_map("w", F.array(F.substring("line", 1, 1))).group_by(["w"], F.count("*").alias("n"))
    return counts.lineage().where("w = 'I'").go_back_all().show().select("line")


@query("prov_source_exploded", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT}) AS word FROM documents) WHERE word = 'license.' GROUP BY doc_id")
def prov_source_exploded(t: Tables) -> DataFrame:
    """Rows that were exploded before they are traced: one place in the file holds many records, and each has an id."""
    words = TracedFrame.source(t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")))
    counts = words.group_by(["word"], F.count("*").alias("n"))
    return counts.lineage().where(F.col("word") == "license.").go_back().dump().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("prov_source_joined", "SELECT c_nationkey, count(*) AS inputs FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 4 GROUP BY 1")
def prov_source_joined(t: Tables) -> DataFrame:
    """Rows that were joined before they are traced."""
    sales = TracedFrame.source(t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_totalprice"))
    groups = sales.group_by(["c_nationkey"], F.sum("o_totalprice").alias("total"))
    return groups.lineage().where("c_nationkey < 4").go_back().dump().groupBy("c_nationkey").agg(F.count("*").alias("inputs"))


@query("prov_source_repartitioned", "SELECT l_returnflag, count(*) AS inputs, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def prov_source_repartitioned(t: Tables) -> DataFrame:
    """Rows that were dealt out before they are traced; a walk finds the same records again."""
    lines = TracedFrame.source(t.lineitem.repartition(7))
    at = lines.group_by(["l_returnflag"], F.count("*").alias("n")).lineage().where("l_returnflag <> 'N'").go_back()
    return at.dump().groupBy("l_returnflag").agg(F.count("*").alias("inputs"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("prov_capture_off", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(n_name), ' ')) AS word FROM nation) GROUP BY word")
def prov_capture_off(t: Tables) -> DataFrame:
    """Without capture there are no edges, and the same results."""
    frame = TracedFrame.source(t.nation, ["n_nationkey"], capture=False).flat_map("word", F.split(F.lower("n_name"), " ")).group_by(["word"], F.count("*").alias("n"))
    if frame.edges:
        raise AssertionError("edges were captured")
    return frame.data


@query("prov_id_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 4)")
def prov_id_filter(t: Tables) -> DataFrame:
    at = TracedFrame.source(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).lineage()
    return at.where_id(F.col("id.n_nationkey").isin(3, 4)).show()
