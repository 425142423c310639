"""Small-world graphs against exact search."""

import numpy as np
import pytest

from matchweave.operators import graph_index, vectors


def nearest(x, q, k):
    return set(np.argsort(-(x @ q), kind="stable")[:k].tolist())


@pytest.mark.parametrize("clusters", [0, 12])
def test_a_graph_finds_nearly_all(clusters):
    r = np.random.default_rng(clusters)
    x = r.normal(size=(1500, 32)) + (3 * r.normal(size=(clusters, 32))[r.integers(0, clusters, 1500)] if clusters else 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = graph_index.Graph.load(graph_index.Graph(x).dump())
    asked = range(0, 1500, 50)
    hits = [len(set(graph.search(x[i].astype(np.float32), 10)) & nearest(x, x[i], 10)) for i in asked]
    assert sum(hits) / (10 * len(asked)) >= 0.95
    assert graph.visited / len(asked) < len(x)  # fewer than all
    for k, links in enumerate(graph.levels):
        assert links.shape[1] == (16 if k else 32) and links.max() < 1500


@pytest.mark.parametrize("n", [0, 1, 2, 20])
def test_small_graphs_are_exact(n):
    x = np.eye(24)[:n].reshape(n, 24) + 0.01
    graph = graph_index.Graph(x)
    assert sorted(graph.search(np.ones(24, np.float32), 24)) == list(range(n))


def test_equal_vectors(spark):
    x = np.ones((300, 8)) / 8**0.5
    assert len(set(graph_index.Graph(x).search(x[0].astype(np.float32), 20))) == 20


def test_blocks_are_merged_and_scored_exactly(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(v) for v in r.normal(size=16)]) for i in range(400)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, 2.0]), (504, [2.0, 1.0]), (2**60 + 1, [1.0, 1.0])]
    items = spark.createDataFrame([(a, b, "x") for a, b in rows], "item_id long, embedding array<double>, label string")
    asked = items.where("item_id % 20 = 0 or item_id > 500").selectExpr("item_id AS query_id", "embedding")
    index = graph_index.build(items, block=64)
    assert index.count() >= 7
    got = graph_index.search(index, items, asked, 5).collect()
    assert {r.query_id for r in got} == {i for i in range(0, 400, 20)} | {503, 504, 2**60 + 1}
    same_length = [(a, b) for a, b in rows if b and len(b) == 16 and b[0] == b[0] and any(b)]
    exact = vectors.cosine_topk(spark.createDataFrame(same_length, "item_id long, embedding array<double>"), asked.where("size(embedding) = 16 and query_id < 400"), 5).collect()
    want, have = {(r.query_id, r.item_id, r.score) for r in exact}, {(r.query_id, r.item_id, r.score) for r in got}
    assert len(want & have) >= 0.95 * len(want)
    assert {(r.query_id, r.item_id) for r in got if r.query_id >= 500} == {(a, b) for a in (503, 504, 2**60 + 1) for b in (503, 504, 2**60 + 1) if a != b}
    assert all(r.visited > 0 for r in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    items = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id AS item_id", "embedding")
    asked = items.where("item_id % 20 = 0").selectExpr("item_id AS query_id", "embedding")
    want = {(r.query_id, r.item_id) for r in vectors.cosine_topk(items, asked, 10).collect()}
    have = {(r.query_id, r.item_id) for r in graph_index.search(graph_index.build(items, block=600), items, asked, 10).collect()}
    assert len(want & have) >= 0.9 * len(want)
