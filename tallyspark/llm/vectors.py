"""What the two vector searches share: cleaning, shards, query blocks and top-k merging."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Rows of a shard, on average.
SHARD = 8192
#: Queries of a block, on average. A task holds one shard and one block of queries.
QUERY_BLOCK = 8192

#: (ids, vectors, queries as a table of query_id, vec and what else they carry) -> (rows of the table, vec_id, score)
Search = Callable[[np.ndarray, np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(rows: DataFrame, id_col: str, vec_col: str, allow_zero: bool, k: int) -> DataFrame:
    """``(vec_id, vec, copies)`` of the rows that take part, written once.

    Out are null ids, null or empty vectors, vectors with null or non-finite
    components, all-zero vectors unless allowed, and vectors whose length is not
    the commonest one (the smaller on a tie). Rows equal in id and vector are one row
    here, with how many there are, up to ``k``: no query returns more.
    """
    fine = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # noqa: E731  NaN is above infinity
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine)
    )
    if not allow_zero:
        kept = kept.filter(F.exists("vec", lambda x: x != 0))
    found = materialise(kept.groupBy("vec_id", "vec").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies")), "vectors")
    lengths = found.groupBy(F.size("vec").alias("n")).agg(F.sum("copies").alias("count")).orderBy(F.desc("count"), "n").limit(1).collect()
    return found.filter(F.size("vec") == F.lit(lengths[0]["n"] if lengths else 1))


def queries_of(used: DataFrame, is_query) -> DataFrame:
    """``(query_id, vec)``: one row, of the smallest vector, for each id that is a query."""
    return used.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else np.empty((0, 1))


def search_all(used: DataFrame, queries: DataFrame, search: Search, score_type: str, shard: int, block: int) -> DataFrame:
    """``(query_id, vec_id, score)`` that ``search`` finds in every shard of ``used`` for every query.

    Rows are dealt into shards and queries into blocks by hash, and each pair of a
    shard and a block is one group, so that a task holds about ``shard`` rows and
    ``block`` queries whatever their numbers. No vector passes the driver.
    """
    queries = materialise(queries, "queries")
    shards, blocks = (max(1, math.ceil(frame.count() / size)) for frame, size in ((used, shard), (queries, block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = used.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64() if score_type == "long" else pa.float64())], names)
        again = np.repeat(np.arange(rows.num_rows), rows.column("copies").to_numpy())
        ids, vectors = rows.column("vec_id").to_numpy().astype(np.int64)[again], matrix(rows.column("vec"))[again]
        at, found, scores = search(ids, vectors, asked)
        return pa.table([pa.array(asked.column("query_id").to_numpy().astype(np.int64)[at]), pa.array(found), pa.array(scores)], names)

    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return pairs.applyInArrow(run, f"query_id long, vec_id long, score {score_type}")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all shards, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


class TopK:
    """The best ``k`` (score, id) of each of ``n`` queries; offers come as flat arrays."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.rows = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0)
        self.kth = np.full(n, -np.inf) if floor is None else floor.astype(float).copy()

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.zeros(len(self.kth), bool)
        touched[rows] = True
        old = touched[self.rows]
        r = np.concatenate((self.rows[old], rows))
        i = np.concatenate((self.ids[old], ids))
        s = np.concatenate((self.scores[old], scores))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
        full = place == self.k - 1
        self.kth[r[full]] = np.maximum(self.kth[r[full]], s[full])
        keep = place < self.k
        self.rows = np.concatenate((self.rows[~old], r[keep]))
        self.ids = np.concatenate((self.ids[~old], i[keep]))
        self.scores = np.concatenate((self.scores[~old], s[keep]))
