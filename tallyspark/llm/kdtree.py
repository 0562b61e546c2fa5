"""Exact top-k search by inner product: a KD-tree on every shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .vectors import TopK

LEAF = 128
#: Rows from which each query takes a first bound on its kth score; the driver holds them.
PILOT = 2048
#: Queries of a task that advance together.
TOGETHER = 512


@dataclass
class Tree:
    """Nodes in the order they were split, the root first."""

    #: The children's numbers, -1 in a leaf.
    left: np.ndarray
    right: np.ndarray
    #: Tight boxes, nodes x dimensions.
    low: np.ndarray
    high: np.ndarray
    #: The points of each leaf, None elsewhere.
    rows: list[np.ndarray | None]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The widest side of each tight box is split at its median; equal points stay together."""
    left, right, low, high, rows = [], [], [], [], []

    def add(own: np.ndarray) -> int:
        box = points[own]
        left.append(-1)
        right.append(-1)
        low.append(box.min(0))
        high.append(box.max(0))
        rows.append(own)
        return len(rows) - 1

    todo = [add(np.arange(len(points)))]
    while todo:
        node = todo.pop()
        own, width = rows[node], high[node] - low[node]
        axis = int(width.argmax())
        if len(own) <= leaf or width[axis] == 0:
            continue
        values = points[own, axis]
        lower = values < np.median(values)
        if not lower.any():
            lower = values <= np.median(values)
        rows[node] = None
        left[node], right[node] = add(own[lower]), add(own[~lower])
        todo += [left[node], right[node]]
    return Tree(np.array(left), np.array(right), np.array(low), np.array(high), rows)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs: through doubles where they are exact there, else through 64-bit integers."""
    largest = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * a.shape[1]
    return a @ b.T if largest < 2.0**53 else (a.astype(np.int64) @ b.astype(np.int64).T).astype(float)


def search_tree(ids, points, q_ids, queries, k: int, floor: np.ndarray, leaf: int = LEAF):
    """(row of the query, id, score) by best-first traversal, every query with a queue of its own.

    A box bounds a query's score by the sum over dimensions of the larger of q*lo
    and q*hi. Each round pops from every queue the node of the highest bound: of an
    inner node the children are queued, a leaf's points are scored. A query stops
    when its next bound is below its kth score; ``floor`` carries that score over
    from what was searched before.
    """
    tree = build(points, leaf)
    parts = [_traverse(tree, ids, points, q_ids[s], queries[s], k, floor[s], s.start) for s in (slice(a, a + TOGETHER) for a in range(0, len(queries), TOGETHER))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _traverse(tree: Tree, ids, points, q_ids, queries, k: int, floor, first: int):
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    bounds += 1e-9 * (1 + np.abs(bounds))
    queue = np.full(bounds.shape, -np.inf)
    queue[:, 0] = bounds[:, 0]
    top, active = TopK(len(queries), k, floor), np.arange(len(queries))
    while len(active):
        node = queue[active].argmax(1)
        bound = queue[active, node]
        going = (bound >= top.kth[active]) & (bound > -np.inf)
        active, node = active[going], node[going]
        queue[active, node] = -np.inf
        inner = tree.left[node] >= 0
        for child in (tree.left[node[inner]], tree.right[node[inner]]):
            queue[active[inner], child] = bounds[active[inner], child]
        asked, at = active[~inner], node[~inner]
        if not len(asked):
            continue
        by, got = np.argsort(at, kind="stable"), []
        for rows in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            members, own = tree.rows[at[rows[0]]], asked[rows]
            scores = dot(queries[own], points[members])
            r, c = np.nonzero((scores >= top.kth[own, None]) & (ids[members][None, :] != q_ids[own, None]))
            got.append((own[r], ids[members[c]], scores[r, c]))
        top.offer(*(np.concatenate(x) for x in zip(*got, strict=True)))
    return top.rows + first, top.ids, top.scores.astype(np.int64)


def pilot_floor(q_ids: np.ndarray, queries: np.ndarray, p_ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's kth best is known to reach, from some of the candidates."""
    floor = np.full(len(queries), -np.inf)
    if len(points) > k:
        for at in range(0, len(queries), 1024):
            scores = dot(queries[at : at + 1024], points)
            scores[q_ids[at : at + 1024, None] == p_ids[None, :]] = -np.inf
            floor[at : at + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    return floor


def with_floor(queries: DataFrame, pilot: pa.Table, k: int) -> DataFrame:
    p_ids, points = pilot.column("vec_id").to_numpy().astype(np.int64), vectors.matrix(pilot.column("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = pilot_floor(batch.column("query_id").to_numpy().astype(np.int64), vectors.matrix(batch.column("vec")), p_ids, points, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=["query_id", "vec", "floor"])

    return queries.mapInArrow(run, "query_id long, vec array<double>, floor double")


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = vectors.SHARD,
    query_block: int = vectors.QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest integer inner product for each query, exactly.

    Components become floor(scale * x). ``is_query`` is a condition on ``vec_id``.
    A query's candidates are all rows of another id, fewer than ``k`` if there are
    no more; ties go to the smaller id. Rows that :func:`vectors.usable` leaves out
    take no part. An id that repeats among the queries is answered from one of its
    rows; among the candidates each row counts. Other columns are ignored.
    """
    used = vectors.usable(rows, id_col, vec_col, allow_zero=True, k=k)
    used = used.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    pilot = used.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "vec").limit(PILOT).toArrow()
    queries = with_floor(vectors.queries_of(used, is_query), pilot, k)

    def search(ids, points, asked):
        q_ids = asked.column("query_id").to_numpy().astype(np.int64)
        return search_tree(ids, points, q_ids, vectors.matrix(asked.column("vec")), k, asked.column("floor").to_numpy())

    return vectors.best(vectors.search_all(used, queries, search, "long", shard, query_block), k)
