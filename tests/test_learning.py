"""Learning queries on rows where a cost or a choice that grows with the input would show."""

from tracewright.operators.learning import equal_set_pairs, recovered, weighted


def test_equal_sets_meet_without_pairs(spark):
    sets = [["a", "b"], ["b", "a", "a"]] * 300 + [["a", f"w{i}"] for i in range(500)] + [["w1", "a"], ["a"]]
    found = equal_set_pairs(spark.createDataFrame([(w,) for w in sets], "words array<string>"))
    assert found.first().pairs == 600 * 599 // 2 + 1
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert equal_set_pairs(spark.createDataFrame([], "words array<string>")).first().pairs == 0


def test_ratings_are_found_in_as_many_rounds_as_it_takes(spark):
    chain = [(i, i) for i in range(30)] + [(i, i + 1) for i in range(30)]  # rounds pass a value on by one step
    ratings = spark.createDataFrame([(u, i, (1 + u % 3) * (1 + i % 4) / 4.0) for u, i in chain], "user int, item int, rating double")
    assert tuple(recovered(ratings.where("user < 3"), rounds=1).first()) == (6, 6)


def test_equal_rows_are_one_weighted_row(spark):
    rows = weighted(spark.createDataFrame([(1.0, 2.0)] * 3 + [(2.0, 2.0)], "features double, label double"))
    assert sorted(map(tuple, rows.collect())) == [(1.0, 2.0, 3.0), (2.0, 2.0, 1.0)]
