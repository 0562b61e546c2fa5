"""Near copies: op10's operator with five-word shingles proposes what its radius covers, MinHash bands the rest, exact sets decide.

Covering tables bring together every pair of texts whose SimHash fingerprints differ
in RADIUS bits at most. Of texts with Jaccard similarity 0.8 most differ in more
bits (10 of 64 on average), and covering those would take thousands of tables, so
MinHash bands are searched as well: texts share a band of ROWS minima with
probability J**ROWS, and of pairs with J = 0.8 one in 9,000 shares none of the BANDS
bands, of more similar ones fewer still. Whatever meets by either way is compared
by its whole shingle set, unless links found before connect it already.

No bucket is spelt out as pairs. First each member meets one other of its bucket, a
different one in every band and round; in groups of many copies nearly all links
come together so. What a bucket then still holds apart goes into one task as texts,
which compares what is not connected and passes on a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import forget, materialise, slices, tidy
from .simhash import deal, fingerprint_links, of_hashes, shingle_hashes

SHINGLE = 5
#: The least similarity of near copies is SAME / OF.
SAME, OF = 4, 5
ROWS, BANDS = 6, 30
#: Rounds in which members of a bucket meet one other of it.
ROUNDS = 3
#: The most texts of a bucket that a task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Shingles whose minima are taken at once.
PART = 2048
_rng = np.random.default_rng(10)
_TIMES = _rng.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; a text without words has one of its own."""
    found = np.unique(hashes)
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PART):
        np.minimum(least, (shingles[at : at + PART] * _TIMES + _PLUS).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k * BANDS : (k + 1) * BANDS]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        prints, keys = [], []
        for text in batch.column("text"):
            hashes = shingle_hashes(text.as_py(), SHINGLE)
            prints.append(of_hashes(hashes))
            keys.append(band_keys(distinct_of(hashes)))
        columns = [batch.column("h"), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [distinct_of(shingle_hashes(t.as_py(), SHINGLE)).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(sets, pa.list_(pa.int64()))], names=["h", "set"])


def covered(prints: DataFrame) -> DataFrame:
    """``(u, v)``: the texts that stand for two of the fingerprints ``prints(fp, rep)``, for links that connect all within the radius."""
    links = fingerprint_links(prints.select("fp"))
    first = prints.select(F.col("fp").alias("u"), F.col("rep").alias("first"))
    return links.join(first, "u").join(prints.withColumnRenamed("fp", "v"), "v").select(F.col("first").alias("u"), F.col("rep").alias("v"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("h").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("h").alias("v"), F.col("set").alias("b")), "v"
    )
    same = F.size(F.array_intersect("a", "b"))
    return both.filter(same * OF >= (F.size("a") + F.size("b") - same) * SAME).select("u", "v")


def stars(members: DataFrame, seed: int) -> DataFrame:
    """``(u, v)``: each of ``members(band, h, label)`` and one other of its bucket, where their labels differ.

    The other is one of the bucket's commonest label, by a hash of ``seed`` that few
    bands share, so that what is left of a large group meets the group and not the
    other way round.
    """
    order = F.xxhash64("h", F.col("band").bitwiseAND(F.lit(1)), F.lit(seed))
    by_label = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("order"), "h")).alias("rep"))
    commonest = F.max_by(F.struct("rep.h", "label"), F.struct("n", "rep.order")).alias("centre")
    both = members.join(by_label.groupBy("band").agg(commonest), "band").filter(F.col("label") != F.col("centre.label"))
    return ordered(both.select(F.col("centre.h").alias("u"), F.col("h").alias("v")))


def ordered(pairs: DataFrame) -> DataFrame:
    """The pairs once each, the smaller first."""
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def still_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the buckets that hold several labels, ``labels(node, label)`` being the components so far."""
    apart = members.drop("label").join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
    mixed = apart.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return apart.join(mixed.select("band"), "band", "left_semi").select("band", "h", "label")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the similar pairs within each (band, a, b), for rows sorted by these; the last group of a batch waits for the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = np.column_stack([table.column(c).to_numpy() for c in ("band", "a", "b")])
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)) if len(key) else np.zeros(1, np.int64)
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            yield from _group_links(table.slice(x, y - x))
        held = table.slice(starts[-1]).combine_chunks()
        tidy()
    if held is not None and held.num_rows:
        yield from _group_links(held)


def _group_links(group: pa.Table) -> Iterator[pa.RecordBatch]:
    h, sets = group.column("h").to_numpy(), group.column("set").combine_chunks()
    sizes = sets.value_lengths().to_numpy().astype(np.int64)
    starts = sizes.cumsum() - sizes
    vocabulary, place = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    _, root = np.unique(group.column("label").to_numpy(), return_inverse=True)
    marked = np.zeros(len(vocabulary), np.int64)
    u, v = [], []
    for i in range(len(h) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = place[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        same = np.add.reduceat(marked[place[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        marked[own] = 0
        alike = same * OF >= (sizes[i] + sizes[i + 1 :] - same) * SAME
        for j in np.flatnonzero(alike & (root[i + 1 :] != root[i])) + i + 1:
            if root[i] != root[j]:
                u.append(h[i])
                v.append(h[j])
                root[root == root[j]] = root[i]
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def within_buckets(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all that is similar within the buckets of ``apart(band, h, label)``."""
    order = ["band", "a", "b"]
    texts = deal(apart, ["band"], "h", BLOCK).join(sets, "h").select(*order, "h", "label", "set")
    return texts.repartition(*order).sortWithinPartitions(*order, "h").mapInArrow(_compared, "u long, v long")


def components(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, label)`` for the :func:`text_hash` of every text that has near copies other than itself.

    Null and empty texts are one text. Texts of fewer than five words are one
    shingle, texts without words are alike. An empty table gives no rows; ids and other
    columns take no part.
    """
    texts = docs.select(text_hash(F.col(text_col)).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"))
    marks = materialise(texts.mapInArrow(_marks, "h long, fp long, bands array<bigint>").dropDuplicates(["h"]), "marks")
    prints = materialise(marks.groupBy("fp").agg(F.min("h").alias("rep")), "distinct-fingerprints")
    rows = marks.select("h", F.explode("bands").alias("band"))
    buckets = materialise(rows.groupBy("band").count().filter("count > 1").select("band"), "buckets")
    members = materialise(rows.join(buckets, "band", "left_semi").select("band", "h", F.col("h").alias("label")), "bucket-members")
    same = marks.join(prints, "fp").select(F.col("rep").alias("u"), F.col("h").alias("v"))
    pairs = materialise(ordered(stars(members, 0).union(same).union(covered(prints))), "pairs")
    named = materialise(members.select("h").union(pairs.select("u")).union(pairs.select("v")).distinct(), "named")
    sets = texts.join(named, "h", "left_semi").dropDuplicates(["h"]).mapInArrow(_sets, "h long, set array<bigint>")
    sets = materialise(sets, "shingle-sets")
    links = materialise(similar(pairs, sets), "links")
    labels = connected_components(links)
    apart = materialise(still_mixed(members, labels), "apart")
    forget(marks, prints, buckets, members, pairs, named)
    for seed in range(1, ROUNDS):
        if apart.isEmpty():
            break
        pairs = materialise(stars(apart, seed), "pairs")
        more = materialise(links.union(similar(pairs, sets)), "links")
        labels = connected_components(more)
        left = materialise(still_mixed(apart, labels), "apart")
        forget(pairs, links, apart)
        links, apart = more, left
    if not apart.isEmpty():
        labels = connected_components(links.union(within_buckets(apart, sets)))
    forget(apart, sets, links)
    return labels.withColumnRenamed("node", "h")
