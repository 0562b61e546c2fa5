"""SimHash near-duplicates by covering locality-sensitive hashing.

With bit classes m(i) in {1..31} (five-bit vectors) for the 64 fingerprint bits,
table v in {1..31} keeps the bits whose inner product <m(i), v> is 1 modulo 2. Four
differing bits span at most four dimensions of a five-dimensional space, so some
non-zero v is orthogonal to all of them: any pair within four bits agrees in at
least one table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import forget, materialise, of_text

SHINGLE = 4
RADIUS = 4
#: The most fingerprints compared in one group; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words of a whole text, of all its words if there are no more; none for blank texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    slices = map(joined.__getitem__, map(slice, starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(42)), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one whole text; zero for null, empty or blank texts."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of all shingle hashes of a text, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2**(radius+1)-1 masks, as signed longs."""
    n = 2 ** (radius + 1) - 1
    kept = [[i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2] for v in range(1, n + 1)]
    masks = [sum(1 << i for i in k) for k in kept]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Forest of the pairs within the radius, for rows sorted by bucket; the last bucket of a batch waits for the next."""
    held = None
    for batch in batches:
        table = pa.table(batch) if not isinstance(batch, pa.Table) else batch
        now = np.column_stack([table.column(c).to_numpy() for c in ("t", "key", "a", "b", "fp")])
        if not len(now):
            continue
        now = now if held is None else np.concatenate((held, now))
        new = np.concatenate(([True], (now[1:, :4] != now[:-1, :4]).any(1)))
        last = np.flatnonzero(new)[-1]
        held = now[last:]
        yield from _forest(now[:last, 4], new[:last], radius)
    if held is not None:
        yield from _forest(held[:, 4], np.arange(len(held)) == 0, radius)


def _forest(fps: np.ndarray, new: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(fps))
    end = np.repeat(ends, ends - starts)
    left = np.flatnonzero(np.arange(len(fps)) + 1 < end)
    if not len(left):
        return
    nodes, local = np.unique(fps, return_inverse=True)
    root = np.arange(len(nodes))
    u, v, d = [], [], 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while len(left := left[left + d < end[left]]):
        i, j = local[left], local[left + d]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count((nodes[i] ^ nodes[j]).view(np.uint64)) <= radius
        if near.any():
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if (p := find(x)) != (q := find(y)):
                    root[max(p, q)] = min(p, q)
                    u.append(x)
                    v.append(y)
            while (root != (up := root[root])).any():
                root = up
        d += 1
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    return of_text("long", pa.int64(), lambda t: fingerprint(t, shingle), text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprint_hex(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as 16 hex digits."""
    return as_hex(fingerprint_of(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for every row, duplicates of an id included."""
    return docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col), shingle).alias("fp"))


def deal(members: DataFrame, bucket: list[str], item: str, most: int) -> DataFrame:
    """``members`` with the numbers ``a`` and ``b`` of two blocks: zero in buckets of ``most`` members or fewer.

    Larger buckets are cut into blocks by a hash of ``item``, and each member comes once for
    every pair of its block with another, so that any two members meet in some (bucket, a, b).
    """
    large = members.groupBy(*bucket).count().filter(F.col("count") > most)
    large = materialise(large.select(*bucket, F.ceil(F.col("count") / F.lit(most / 2)).alias("blocks")), "large-buckets")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        return members.withColumns({"a": zero, "b": zero})
    own = F.coalesce(F.pmod(F.xxhash64(item), F.col("blocks")), zero)
    other = F.explode(F.sequence(zero, F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    dealt = members.join(large, bucket, "left").select(*members.columns, own.alias("own"), other.alias("other"))
    return dealt.select(*members.columns, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the distinct fingerprints ``fp`` that chains of pairs within ``radius`` bits connect.

    Buckets hold distinct fingerprints only, so exact copies never meet here. Within
    a bucket only pairs not yet connected are compared, and a spanning forest leaves
    the task instead of all pairs. Buckets of more than BLOCK fingerprints are cut
    into blocks, and each pair of blocks is a group of its own.
    """
    masks = covering_masks(radius)
    members = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key")
    )
    dealt = deal(members, ["t", "key"], "fp", BLOCK)
    dealt = dealt.withColumn("t", F.col("t").cast("long"))
    order = ["t", "key", "a", "b"]
    return (
        dealt.repartition(*order)
        .sortWithinPartitions(*order, "fp")
        .mapInArrow(lambda batches: _links(batches, radius), "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row for each input row.

    Null, empty and blank texts have fingerprint zero, which links like any other.
    Rows that repeat an id keep their own rows. A null id is never a component_id
    unless its whole component has none. An empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    labels = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = materialise(
        distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "rep", F.coalesce("label", "fp").alias("label")
        ),
        "labelled",
    )
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = materialise(named.join(least, "label").select("fp", "component_id"), "components")
    return fps.join(known, "fp").select(
        F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )
