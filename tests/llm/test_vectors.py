import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import kdtree, rpforest, vectors

KIND = "vec_id long, embedding array<float>, label int, score string"


def rows(seed, n=700, d=8, copies=60):
    rng = random.Random(seed)
    out = [[i, [float(np.float32(rng.gauss(0, 0.4))) for _ in range(d)], 1, "x"] for i in range(n)]
    for i in range(0, copies * 7, 7):
        out[i][1] = out[0][1]
    out[20][1], out[40][1] = None, [1.0] * (d - 1) + [float("nan")]
    out[60][1], out[80][1], out[100][1] = [float("inf")] + [0.0] * (d - 1), [None] + [0.0] * (d - 1), [1.0, 2.0]
    out[120][1], out[140][1] = [], [0.0] * d
    return [tuple(r) for r in out]


def fine(v, d, zero):
    return bool(v) and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def slow(table, d, k, every, score, zero):
    used = [(i, v) for i, v, *_ in table if fine(v, d, zero)]
    out = []
    for q, a in used:
        if q % every == 0:
            found = sorted((-score(a, b), i) for i, b in used if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def whole(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_top_k(spark, seed):
    table = rows(seed)
    got = kdtree.top_k(spark.createDataFrame(table, KIND), F.col("vec_id") % 20 == 0, shard=200, query_block=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == slow(table, 8, 5, 20, whole, True)


def test_tree_skips_boxes():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(0, 300, (4000, 2)))
    tree = kdtree.build(points, 64)
    leaves = [r for r in tree.rows if r is not None]
    for node, rows in enumerate(tree.rows):  # tight boxes, within those of the node above
        if rows is None:
            below = [tree.left[node], tree.right[node]]
            assert (tree.low[below].min(0) == tree.low[node]).all() and (tree.high[below].max(0) == tree.high[node]).all()
    assert sorted(np.concatenate(leaves)) == list(range(4000)) and max(map(len, leaves)) <= 64
    asked = []
    real = kdtree.dot
    try:
        kdtree.dot = lambda a, b: asked.append(len(b)) or real(a, b)
        kdtree.search_tree(np.arange(4000), points, np.array([-1]), np.array([[5.0, 3.0]]), 5, np.array([-np.inf]), 64)
    finally:
        kdtree.dot = real
    assert sum(asked) < 1000


def test_large_components_stay_exact():
    a = np.array([[2.0**27 + 1, 3.0]])
    assert kdtree.dot(a, a)[0, 0] == float((2**27 + 1) ** 2 + 9)


def test_forest_recall_and_ties(spark):
    table = rows(5, n=900, d=12)
    got = [tuple(r) for r in rpforest.nearest(spark.createDataFrame(table, KIND), F.col("vec_id") % 20 == 0, shard=300).collect()]
    true = slow(table, 12, 20, 20, lambda a, b: float((np.array(a) * np.array(b)).sum()), False)
    assert len(got) == len(true)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in true}) >= 0.9 * len(true)
    by = {i: v for i, v, *_ in table}
    assert all(s == pytest.approx(float(np.dot(by[q], by[i])), abs=1e-12) for q, _, i, s in got)
    hot = sorted((r, i) for q, r, i, _ in got if q == 0)
    assert [i for _, i in hot if by[i] == by[0]] == sorted(i for _, i in hot if by[i] == by[0])


def test_recall_on_the_test_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = rpforest.nearest(table, F.col("vec_id") % 20 == 0).collect()
    every = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    ids, x = np.array([i for i, _ in every]), np.array([v for _, v in every])
    right = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        right += len(set(ids[np.argsort(-s)[:20]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert right >= 0.9 * len(got)


@pytest.mark.parametrize(("n", "most"), [(500, 0.6), (2000, 0.4), (8192, 0.3)])
def test_recall_and_rows_scored(n, most):
    """On a shard of directions without any structure, the hardest that there is."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = rpforest.build_forest(x, rpforest.TREES, rpforest.LEAF, 7)
    right = scored = 0
    for q in range(40):
        own = rpforest.candidates(forest, forest.normals @ x[q] - forest.cuts, n, rpforest.FACTOR * n**rpforest.POWER)
        s = x @ x[q]
        s[q] = -9
        right += len(set(np.argsort(-s)[:20].tolist()) & set(own.tolist()))
        scored += len(own)
    assert right >= 0.9 * 40 * 20 and scored <= most * 40 * n


def test_repeated_rows(spark):
    """Rows equal in id and vector count each, up to k; one id with two vectors is asked by the smaller."""
    table = [(1, [1.0, 0.0], 1, None)] * 5 + [(2, [1.0, 1.0], 1, None), (2, [0.0, 1.0], 1, None), (3, [2.0, 2.0], 1, None)]
    got = kdtree.top_k(spark.createDataFrame(table, KIND), F.col("vec_id") == 2, k=3, shard=2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 3, 2 * 256**2), (2, 1, 0), (3, 1, 0)]


@pytest.mark.parametrize("find", [kdtree.top_k, rpforest.nearest])
def test_edges(spark, find):
    cond = F.col("vec_id") % 2 == 0
    assert find(spark.createDataFrame([], KIND), cond).count() == 0
    few = [(0, [1.0, 2.0], 1, None), (1, [1.0, 0.5], 1, None), (None, [3.0, 3.0], 1, None), (2, None, 1, None)]
    got = find(spark.createDataFrame(few, KIND), cond).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    same = [(i, [0.5, 0.5], 1, None) for i in range(600)]
    got = find(spark.createDataFrame(same, KIND), F.col("vec_id") == 4, k=3).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2]


def test_top_k_offers_in_parts():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 9, (30, 50)).astype(float)
    top = vectors.TopK(30, 4)
    for at in range(0, 50, 10):
        r, c = np.nonzero(np.ones((30, 10), bool))
        top.offer(r, c + at, s[r, c + at])
    for q in range(30):
        mine = sorted(zip(-top.scores[top.rows == q], top.ids[top.rows == q], strict=True))
        assert mine == sorted(zip(-s[q], range(50), strict=True))[:4]
