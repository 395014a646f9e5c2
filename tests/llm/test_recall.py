"""Recall of the near-duplicate joins on planted pairs that no third member connects."""

import numpy as np

from tracewright.llm import jaccard_join


def word_maker(prefix):
    n = 0

    def words(k):
        nonlocal n
        n += k
        return [f"{prefix}{i}" for i in range(n - k, n)]

    return words


def lost(found, pairs):
    component = {r.doc_id: r.component_id for r in found.collect()}
    return sum(component[a] != component[b] for a, b in pairs)


def test_jaccard_pairs_of_short_texts(spark):
    words, rows = word_maker("s"), []
    for union in (5, 10, 15, 20, 25):
        for _ in range(200):
            w = words(union + 4)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: union * 4 // 5 + 4]))]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert lost(found, [(i, i + 1) for i in range(0, len(rows), 2)]) <= 2


def test_jaccard_pairs_that_meet_in_large_nodes_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIMIT", 0)  # every node counts as large and of many groups,
    monkeypatch.setattr(jaccard_join, "BLOCK", 1)  # is not compared in itself,
    monkeypatch.setattr(jaccard_join, "PAIRS", 0)  # nor in pairs of blocks before the last level
    words, rows = word_maker("d"), []
    for _ in range(2000):
        w = words(54)
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:44]))]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert lost(found, [(i, i + 1) for i in range(0, len(rows), 2)]) <= 4
