"""Invariants of traces: back and forth, replay, exact ids."""

from pyspark.sql import functions as F

from tracewright.plans.debugger import DebugSession, guarded
from tracewright.plans.provenance import RID, TracedFrame


def frame(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, None), (4, "c c")], "k int, line string")
    return TracedFrame.source(rows, ["k"])


def counts(source):
    return source.flat_map("w", F.split("line", " ")).group_by(["w"], F.count("*").alias("n"))


def test_forward_of_back_holds_the_selection(spark):
    at = counts(frame(spark)).lineage().where("w = 'b'")
    back = at.go_back_all()
    assert sorted(r.k for r in back.show().collect()) == [1, 2]
    assert {r.w for r in back.go_next().go_next().show().collect()} == {"a", "b", "c"}


def test_replay_of_the_traced_inputs_gives_the_group(spark):
    source = frame(spark)
    c = counts(source)
    rows = c.lineage().where("w = 'c'").go_back_all().dump()
    assert [(r.w, r.n) for r in c.replay(source, rows).where("w = 'c'").collect()] == [("c", 3)]


def test_null_keys_are_a_group_with_a_trace(spark):
    g = frame(spark).group_by(["line"], F.count("*").alias("n"))
    assert [r.k for r in g.lineage().where("line is null").go_back().show().collect()] == [3]


def test_ids_are_values_not_hashes(spark):
    assert frame(spark).df.select(RID).distinct().count() == 4


def test_guard_keeps_every_record_somewhere(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    g = guarded(rows, lambda r: 10 // r["x"], "long", "id")
    assert g.ok.count() + g.quarantine.count() == 100
    assert g.quarantine.where("error like 'ZeroDivisionError%'").count() == 15
    assert g.modify({"x": F.lit(5).cast("long")}).count() == 100


def test_the_function_runs_once_a_record(spark):
    calls = spark.sparkContext.accumulator(0)

    def function(record):
        calls.add(1)
        return 10 // record["x"]

    g = guarded(spark.range(30).withColumn("x", F.col("id") % 3), function, "long", "id")
    assert g.ok.count() == 20 and g.quarantine.count() == 10 and g.skip().count() == 20
    assert calls.value == 30
    assert g.modify({"x": F.lit(5).cast("long")}).count() == 30
    assert calls.value == 40  # the failed records only
    assert g.resolve(0, "skip").quarantine.count() == 9 and calls.value == 40
    fixed = g.fix(lambda r: 0)
    assert fixed.ok.count() == 30 and fixed.quarantine.count() == 0 and calls.value == 40


def test_functions_see_nulls_as_none_and_wrong_kinds_are_failures(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id long, x long")
    seen = guarded(rows, lambda r: r["x"] is None, "boolean", "id")
    assert {r.id: r.result for r in seen.ok.collect()} == {1: True, 2: False, 3: False}
    odd = guarded(rows, lambda r: "text" if r["id"] == 2 else r["x"], "long", "id")
    assert {r.id: r.result for r in odd.ok.collect()} == {1: None, 3: 7} and [r.rid for r in odd.quarantine.collect()] == [2]


def test_text_lines_keep_their_ids(spark, tmp_path):
    """Lines are numbered once: other splits in a later walk meet the same records."""
    for part in "ab":
        (tmp_path / part).mkdir()
        (tmp_path / part / "x.txt").write_text("same\nother\nsame\n")
    lines = TracedFrame.source(spark.read.text([str(tmp_path / p) for p in "ab"]))
    assert lines.df.select(RID).distinct().count() == 6
    groups = lines.group_by(["value"], F.count("*").alias("n"))
    cursor = groups.lineage().where("value = 'same'").go_back()
    first = sorted(map(str, cursor.dump().collect()))
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "7")
        again = groups.lineage().where("value = 'same'").go_back().dump().collect()
    finally:
        spark.conf.set(key, old)
    assert sorted(map(str, again)) == first and len(first) == 4
    assert {r[RID].path.rsplit("/", 2)[1] for r in again} == {"a", "b"}


def test_ids_of_rows_that_are_no_bare_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6).selectExpr("id", "id % 2 AS k").coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    frames = [scan.select("id", F.explode(F.array("id", "k"))), scan.join(spark.range(4).toDF("j")), scan.repartition(3), scan.union(scan), scan.groupBy("k").count(), scan.sample(0.99, 1).union(scan.limit(2))]
    for df in frames:
        traced = TracedFrame.source(df)
        assert traced.df.select(RID).distinct().count() == traced.df.count() > 0
    bare = TracedFrame.source(scan.where("id > 1").select("k")).df
    assert "Scan parquet" in bare._jdf.queryExecution().simpleString() and bare.select(RID).distinct().count() == 4


def test_first_records_of_an_order_with_ties(spark):
    rows = TracedFrame.source(spark.range(50).selectExpr("id", "0 AS k"), ["id"]).limit_by(3, "k")
    assert sorted(r.id for r in rows.data.collect()) == [0, 1, 2]


def test_union_keeps_ids_of_unlike_kinds_apart(spark):
    a = TracedFrame.source(spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.000001' AS k, 'x' AS v UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:00.000002', 'y'"), ["k"]).select("v")
    b = TracedFrame.source(spark.sql("SELECT 1 AS j, 'z' AS v"), ["j"]).select("v")
    both = a.union(b)
    assert both.df.select(RID).distinct().count() == 3
    assert [r.v for r in both.lineage().where("v = 'y'").go_back(0).show().collect()] == ["y"]
    assert both.replay(b, b.df.limit(0)).count() == 2


def test_lazy_repair_stops_at_its_limit(spark):
    g = guarded(spark.range(20), lambda r: 1 // 0, "long", "id")
    try:
        g.lazy_modify(spark.range(1), limit=10)
        raise AssertionError("it went on")
    except RuntimeError:
        pass


def test_session_stops_and_goes_on(spark):
    s = DebugSession(spark.range(10), [("a", lambda d: d.where("id > 2")), ("b", lambda d: d.where("id > 5"))])
    s.breakpoint("b")
    assert s.resume().count() == 7
    assert s.resume().count() == 4
    assert s.kill_and_run().count() == 7
