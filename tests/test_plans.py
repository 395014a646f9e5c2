"""Plans that must hold at scale: what reaches the scan, and which joins are broadcast."""

from tracewright.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    from tracewright.operators.projection import scan_pruned

    p = plan(scan_pruned(Tables(spark, sf_dir)))
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def test_aggregation_combines_before_the_shuffle(spark, sf_dir):
    from tracewright.operators.aggregates import agg_pricing_summary

    assert "partial_sum" in plan(agg_pricing_summary(Tables(spark, sf_dir)))


def test_limit_is_pushed_into_the_window(spark, sf_dir):
    from tracewright.operators.sorting import topk_per_group

    assert "WindowGroupLimit" in plan(topk_per_group(Tables(spark, sf_dir)))


def test_edges_cost_nothing_until_walked(spark, sf_dir):
    """The traced word count plans one aggregation, with no join and no list of inputs."""
    from tracewright.plans.provenance_queries import word_count

    p = plan(word_count(Tables(spark, sf_dir))[1].data)
    assert "Join" not in p and "collect_list" not in p


def test_a_walk_back_from_a_group_by_its_key_is_one_filtered_scan(spark, sf_dir):
    """The groups are not computed: the key's condition goes to the exploded words, whose ids hold the documents' ids."""
    from pyspark.sql import functions as F

    from tracewright.plans.provenance_queries import word_count

    at = word_count(Tables(spark, sf_dir))[1].lineage().where(F.col("word") == "license.").go_back_all()
    p = plan(at.ids)
    assert p.count("Scan parquet") == 1 and "Join" not in p and "license." in p
