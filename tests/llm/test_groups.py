"""Repeated ids, small blocks, hubs and dense labels: the near-duplicate operators against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import components, embedding_dedup, jaccard_join
from tracewright.llm.components import grouped, label_components, linked_labels, matrix_components
from tracewright.llm.embedding_dedup import near_embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")


def brute(x, label, threshold=0.98):
    """Links and component (smallest row) of each row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    return near.sum(1), matrix_components(near)


def test_embedding_ids_that_repeat(spark):
    got = near_embeddings(vectors(spark, [(1, [1, 0], 1), (2, [1, 0.01], 1), (1, [1, 0.02], 2), (1, [1, 0, 0], 1), (4, [1, 0.021], 2)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (4, 1, 1)]


def test_jaccard_ids_that_repeat(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "y"]), (3, [*b, "y"]), (5, b)]
    found = jaccard_join.jaccard_join(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in found.collect()) == [(1, 1, 1), (1, 3, 1), (2, 1, 1), (3, 3, 1), (3, 3, 1), (5, 3, 1)]


def family(seed, n):
    """A dense family: copies of one text, each with a few words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"f{seed}w{i}" for i in range(80)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 3)):
            words[at] = f"own{seed}x{k}"
        out.append(" ".join(words))
    return out


def test_small_blocks_and_nodes_change_nothing(spark, monkeypatch):
    texts = family(1, 150) + family(2, 90) + family(3, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = np.array([[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    want = list(zip(range(len(texts)), near.sum(1).tolist(), matrix_components(near).tolist(), strict=True))
    for limit, block, exact, pairs in ((256, 512, 2048, 1000), (20, 16, 16, 1000), (4, 30, 40, 0)):
        monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
        monkeypatch.setattr(jaccard_join, "LIMIT", limit)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "EXACT", exact)
        assert sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()) == want


def dense_label(n, pairs, seed=0):
    """Vectors around one direction (mean cosine about 0.8), with planted pairs of cosine 0.982 among them."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * np.sqrt(0.2)
    x[:, 0] += np.sqrt(0.8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        y = rng.standard_normal(64)
        y -= (y @ x[2 * k]) * x[2 * k]
        y /= np.linalg.norm(y)
        x[2 * k + 1] = 0.982 * x[2 * k] + np.sqrt(1 - 0.982**2) * y
    return x


@pytest.mark.parametrize("rounds, window", [(6, 48), (6, 4), (1, 2)])
def test_dense_labels_keep_their_pairs(spark, rounds, window):
    x = dense_label(4000, 300)
    label = (np.arange(len(x)) >= 3000).astype(int)
    n, root = brute(x, label)
    got = {r.vec_id: r for r in near_embeddings(vectors(spark, zip(range(len(x)), x.tolist(), label.tolist(), strict=True)), window=window, rounds=rounds).collect()}
    linked = np.flatnonzero(n)
    found = np.mean([got[i].n_links == n[i] and got[i].component_id == root[i] for i in linked.tolist()])
    assert len(linked) >= 600 and found >= (1 if rounds == 1 else 0.985)
    assert all(got[i].n_links <= n[i] for i in range(len(x)))


def test_tight_groups_take_no_further_passes(spark, monkeypatch):
    """A large group of near copies beside scattered vectors and pairs: one round of passes, and every link counted."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal(32) + 0.05 * rng.standard_normal((700, 32)), rng.standard_normal((600, 32))])
    x[700:800] = x[800:900] + 0.05 * rng.standard_normal((100, 32))
    label = np.zeros(len(x), int)
    n, root = brute(x, label)
    asked = []
    monkeypatch.setattr(embedding_dedup, "_by_label", lambda todo: asked.append(1))
    got = {r.vec_id: r for r in near_embeddings(vectors(spark, zip(range(len(x)), x.tolist(), label.tolist(), strict=True))).collect()}
    assert not asked and np.mean([got[i].n_links == n[i] and got[i].component_id == root[i] for i in range(len(x))]) > 0.995


def test_small_blocks_of_vectors_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(16) + 0.04 * rng.standard_normal((n, 16)) for n in (120, 40, 3, 1)])
    label = np.zeros(len(x), int)
    n, root = brute(x, label)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 12)
    got = near_embeddings(vectors(spark, zip(range(len(x)), x.tolist(), label.tolist(), strict=True))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == list(zip(range(len(x)), n.tolist(), root.tolist(), strict=True))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    monkeypatch.setattr(components, "HUBS", 10)
    rng = np.random.default_rng(1)
    a = np.concatenate([np.zeros(200, np.int64), rng.integers(300, 500, 150), np.full(60, 900)])
    b = np.concatenate([np.arange(1, 201), rng.integers(300, 500, 150), np.arange(840, 900)])
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(5)
    keep = a != b
    node, root = label_components(a[keep], b[keep])
    assert {r.node: r.component for r in components.connected_components(edges, 0).collect()} == dict(zip(node.tolist(), root.tolist(), strict=True))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), max_size=5), max_size=5))
def test_grouped_gives_runs_of_equal_keys(parts):
    flat = sorted(x for p in parts for x in p)
    cut, batches = 0, []
    for p in parts:
        rows = flat[cut : cut + len(p)]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["x", "y"]))
        cut += len(p)
    got = [list(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True)) for t in grouped(iter(batches), ["x", "y"])]
    assert [x for g in got for x in g] == flat and [g[0] for g in got] == sorted(set(flat)) and all(len(set(g)) == 1 for g in got)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.randoms())
def test_matrix_components(n, rng):
    near = np.zeros((n, n), bool)
    for _ in range(rng.randrange(2 * n)):
        i, j = rng.randrange(n), rng.randrange(n)
        near[i, j] = near[j, i] = i != j
    node, root = label_components(*[np.append(x, np.arange(n)) for x in np.nonzero(near)])
    assert matrix_components(near).tolist() == root.tolist()
    labels = np.array([rng.randrange(3) for _ in range(n)])
    i, j = np.nonzero(near)
    assert set(zip(*[x.tolist() for x in linked_labels(near, labels, labels)], strict=True)) == set(zip(labels[i].tolist(), labels[j].tolist(), strict=True))


def test_crowds_are_compared_once(spark, monkeypatch):
    """Texts of Jaccard 0.78 that meet in large nodes of all runs, near copies among them: few rows with sketches, and every link."""
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join([*common, *[f"own{k}x{i}" for i in range(8)]]) for k in range(400)]
    texts += [t + f" more{k}" for k, t in enumerate(texts[:40])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = np.array([[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    rows = []
    for name in ("inside_blocks", "all_pairs"):
        def counting(df, *args, real=getattr(jaccard_join, name), **kwargs):
            rows.append(df.count())
            return real(df, *args, **kwargs)

        monkeypatch.setattr(jaccard_join, name, counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == list(zip(range(len(texts)), near.sum(1).tolist(), matrix_components(near).tolist(), strict=True))
    assert sum(rows) <= 4 * len(texts), rows
