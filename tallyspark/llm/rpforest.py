"""Approximate nearest neighbours: a forest of random-projection trees on every shard.

Each shard has trees of its own, so a query visits the same part of the index at
any size. Inner products become distances by one more component that gives all
indexed vectors the same length; only the trees see it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from . import vectors
from .vectors import TopK

TREES = 64
LEAF = 16
#: A query's leaves hold FACTOR * n ** POWER different rows of a shard of n before it stops; these are scored.
FACTOR, POWER = 3.2, 0.72
#: Queries whose distances to all cuts a task holds at a time.
TOGETHER = 64
#: Rows of a node from which the direction of its split is drawn, and how often it is turned towards their spread.
SPREAD, TURNS = 256, 2


@dataclass
class Forest:
    """The inner nodes of all trees, and their leaves."""

    normals: np.ndarray
    cuts: np.ndarray
    #: What lies below and above each cut: an inner node's number, or -1 - a leaf's.
    below: list[int]
    above: list[int]
    leaves: list[np.ndarray]
    roots: list[int]


def build_forest(points: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
    """Trees whose nodes are split at the median along a random direction, turned towards where the node's rows spread.

    A node that no direction splits, as of equal vectors, is a leaf.
    """
    rng = np.random.default_rng(seed)
    normals, cuts, below, above, leaves, roots = [], [], [], [], [], []

    def grow(own: np.ndarray) -> int:
        """The number of a new node or leaf; its own parts are put on the list."""
        if len(own) > leaf:
            some = points[own if len(own) <= SPREAD else own[rng.integers(len(own), size=SPREAD)]]
            some = some - some.mean(0)
            v = rng.standard_normal(points.shape[1])
            for _ in range(TURNS):
                v = some.T @ (some @ v)
                v /= np.sqrt(v @ v) or 1.0
            along = points[own] @ v
            cut = np.median(along)
            low = along < cut
            if low.any() and not low.all():
                normals.append(v)
                cuts.append(cut)
                below.append(0)
                above.append(0)
                todo.append((len(cuts) - 1, own[low], own[~low]))
                return len(cuts) - 1
        leaves.append(own)
        return -len(leaves)

    for _ in range(trees):
        todo: list[tuple[int, np.ndarray, np.ndarray]] = []
        roots.append(grow(np.arange(len(points))))
        while todo:
            node, low, high = todo.pop()
            below[node], above[node] = grow(low), grow(high)
    return Forest(np.array(normals).reshape(-1, points.shape[1]), np.array(cuts), below, above, leaves, roots)


def candidates(forest: Forest, margins: np.ndarray, rows: int, want: float, leaf: int = LEAF) -> np.ndarray:
    """The rows of the leaves that one queue over all trees gives first, until they hold ``want`` different ones.

    A node's priority is the sum of squared distances to the cuts on the wrong side
    of which it lies. ``margins`` are the query's signed distances to all cuts. A larger
    leaf, of equal vectors, counts as ``leaf`` rows.
    """
    margin = margins.item
    below, above, leaves = forest.below, forest.above, forest.leaves
    queue = [(0.0, n, root) for n, root in enumerate(forest.roots)]
    count, seen, found = len(queue), np.zeros(rows, bool), 0
    while queue and found < want:
        far, _, node = heapq.heappop(queue)
        while node >= 0:
            m = margin(node)
            near, other = (below[node], above[node]) if m < 0 else (above[node], below[node])
            heapq.heappush(queue, (far + m * m, count, other))
            count += 1
            node = near
        own = leaves[-1 - node]
        found += min(leaf, len(own) - int(np.count_nonzero(seen[own])))
        seen[own] = True
    return np.flatnonzero(seen)


def search_forest(ids, points, q_ids, queries, k: int, trees=TREES, leaf=LEAF, factor=FACTOR, power=POWER, seed: int = 7):
    """(row of the query, id, score): the best of each query's :func:`candidates`, by exact scores."""
    length = (points**2).sum(1)
    lifted = np.column_stack((points, np.sqrt(np.maximum(0, length.max() - length))))
    asked = np.column_stack((queries, np.zeros(len(queries))))
    asked *= np.sqrt(length.max()) / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
    forest = build_forest(lifted, trees, leaf, seed)
    want = factor * len(points) ** power
    top = TopK(len(queries), k)
    for at in range(0, len(queries), TOGETHER):
        rows, got, scores = [], [], []
        margins = asked[at : at + TOGETHER] @ forest.normals.T - forest.cuts
        for r in range(at, min(at + TOGETHER, len(queries))):
            own = candidates(forest, margins[r - at], len(points), want, leaf)
            own = own[ids[own] != q_ids[r]]
            s = (points[own] * queries[r]).sum(1)
            if len(own) > k:
                near = s >= np.partition(s, -k)[-k]
                own, s = own[near], s[near]
            rows.append(np.full(len(own), r))
            got.append(ids[own])
            scores.append(s)
        top.offer(np.concatenate(rows), np.concatenate(got), np.concatenate(scores))
    return top.rows, top.ids, top.scores


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = vectors.SHARD,
    query_block: int = vectors.QUERY_BLOCK,
    factor: float = FACTOR,
    power: float = POWER,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: ``k`` rows of large inner product for each query, by exact scores among the candidates.

    All rows are indexed. ``is_query`` is a condition on ``vec_id``; a query's
    candidates are all rows of another id, and ties go to the smaller id. Rows that
    :func:`vectors.usable` leaves out and all-zero vectors take no part. An id that
    repeats among the queries is answered from one of its rows. Other columns are
    ignored.
    """
    used = vectors.usable(rows, id_col, vec_col, allow_zero=False, k=k)

    def search(ids, points, asked):
        q_ids, own = asked.column("query_id").to_numpy().astype(np.int64), vectors.matrix(asked.column("vec"))
        return search_forest(ids, points, q_ids, own, k, factor=factor, power=power)

    return vectors.best(vectors.search_all(used, vectors.queries_of(used, is_query), search, "double", shard, query_block), k)
