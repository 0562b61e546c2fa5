"""Removal of passages that repeat, word by word, within a text or across texts.

A window is WINDOW consecutive words. Of the GRAM-word sequences of a window one has
the smallest hash, its anchor; equal windows have equal anchors, so windows that can
be equal are found by anchor alone. Windows in a row with the same anchor are one
segment, some fifteen windows on average, and a text is cut into segments as it is
read; only numbers are shuffled:

1. Texts that are the same word by word stand for each other.
2. Segments are counted by (anchor, hash). Where every segment of an anchor is the
   same one, its windows repeat if it occurs twice, and no text is needed.
3. Other anchors hold different segments that may share windows. One copy of each is
   fetched, and the suffixes that begin in it are compared in a suffix tree of their
   group: sorted by words, with the length that neighbours have in common. A node at
   least WINDOW words deep is a repeat, and all suffixes below it are repeated windows.
   Suffixes are split into groups by a prefix as long as needed: the anchor alone where it
   has at most GROUP suffixes, else the anchor and the first words of PREFIXES; beyond the
   last, whole windows are counted, which takes no group at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise, slices, tidy

WINDOW, GRAM = 35, 8
#: The most suffixes of a group, about 50 MB of words and numbers.
GROUP = 1 << 17
#: Words of the prefixes by which the suffixes of a large group are split, one after the other.
PREFIXES = (12, 20)
#: Words that a task remembers the hashes of.
WORDS = 500_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_mix = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Hashes(dict):
    """The hash of each word, of its UTF-8 bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            step = [np.uint64(pow(b, size, 1 << 64)) for b in self.bases]
            self.up, self.down = (np.concatenate([x, x * s]) for x, s in zip((self.up, self.down), step, strict=True))
        return self.up[:n], self.down[:n]


def words_of(text: bytes | None) -> list[bytes]:
    """Splitting bytes at white space splits at 0x20 and 0x09 to 0x0D only."""
    return (text or b"").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _mix[0]
    h = (h ^ h >> np.uint64(27)) * _mix[1]
    return h ^ h >> np.uint64(31)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def segments(hashes: np.ndarray, powers: tuple[Powers, Powers]) -> dict[str, np.ndarray]:
    """The segments of a text of word hashes, in order.

    ``anchor`` and the segment's own hash ``high``, ``low``; ``first``, the word at
    which its first window starts, and ``windows``, how many there are; ``twice``: whether the
    anchor stands in it more than once, without which no window can.
    """
    n = len(hashes)
    sums = []
    for p in powers:
        up, _ = p.of(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=total[1:])
        sums.append(total)
    down = powers[0].of(n + 1)[1]
    grams = mixed((sums[0][GRAM:] - sums[0][:-GRAM]) * down[: n - GRAM + 1])
    anchors = _least(grams, WINDOW - GRAM + 1)
    new = np.ones(len(anchors), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(anchors)))
    ends = first + windows + WINDOW - 1
    high, low = (mixed((s[ends] - s[first]) * p.of(n + 1)[1][first]) for s, p in zip(sums, powers, strict=True))
    # where the grams of an anchor stand: those that are the least of some window
    wide = np.full(len(grams) + WINDOW - GRAM, np.iinfo(np.uint64).max, np.uint64)
    wide[WINDOW - GRAM : WINDOW - GRAM + len(anchors)] = ~anchors
    stands = np.flatnonzero(~_least(wide, WINDOW - GRAM + 1) == grams)
    again = grams[stands[1:]] == grams[stands[:-1]]
    until = np.concatenate(([0], again.cumsum()))
    low_at, high_at = np.searchsorted(stands, first), np.searchsorted(stands, ends - GRAM, "right") - 1
    twice = until[high_at] - until[np.minimum(low_at, high_at)] > 0
    return {"anchor": anchors[first], "high": high, "low": low, "first": first, "windows": windows, "twice": twice}


SEGMENT = ("anchor", "high", "low", "first", "windows", "twice")
SEGMENTS = "anchor array<bigint>, high array<bigint>, low array<bigint>, first array<int>, windows array<int>, twice array<boolean>"


class Cutter:
    """Cuts texts into segments, with what it remembers from one to the next."""

    def __init__(self):
        self.hashes, self.powers = Hashes(), (Powers(BASES[0]), Powers(BASES[1]))

    def segments(self, words: list[bytes]) -> dict[str, np.ndarray]:
        if len(words) < WINDOW:
            return {name: np.zeros(0, np.uint64) for name in SEGMENT}
        own = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        return segments(own, self.powers)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words counted and hashed as they are, and its segments."""
    cutter = Cutter()
    for batch in slices(batches, "text"):
        counts, digests, found = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = words_of(text.as_py())
            counts.append(len(words))
            digests.append(sha256(b" ".join(words)).hexdigest())
            found.append(cutter.segments(words))
        columns = [batch.column(c) for c in ("k1", "k2", "own")] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
        columns += [pa.array([_signed(x[c]) for x in found], pa.list_(pa.int64())) for c in SEGMENT[:3]]
        columns += [pa.array([x[c].astype(np.int32) for x in found], pa.list_(pa.int32())) for c in SEGMENT[3:5]]
        columns += [pa.array([x["twice"].astype(bool) for x in found], pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "own", "n_words", "digest", *SEGMENT])


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, k1, k2, own, text)``: 128 bits that name a text, the id as text, and the text, empty for null."""
    text = F.coalesce(text_col, F.lit(""))
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), own.alias("own"), text.alias("text"))


def different(texts: DataFrame) -> DataFrame:
    """Each different text of :func:`named` once, numbered ``rid``: how many there are, the least ``own``, its words and segments."""
    marks = texts.select("k1", "k2", "own", "text").mapInArrow(_marks, f"k1 long, k2 long, own string, n_words long, digest string, {SEGMENTS}")
    once = marks.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("own").alias("own"), *[F.first(c).alias(c) for c in ("n_words", "digest", *SEGMENT)]
    )
    return materialise(once.withColumn("rid", F.monotonically_increasing_id()), "texts")


def live_segments(once: DataFrame) -> DataFrame:
    """``(rid, anchor, high, low, first, windows, mixed)`` of segments that may repeat; ``mixed``: not all of their anchor are the same."""
    each = once.select("rid", F.explode(F.arrays_zip(*SEGMENT)).alias("s")).select("rid", "s.*")
    least_most = [f("high").alias(f"{f.__name__}_high") for f in (F.min, F.max)] + [f("low").alias(f"{f.__name__}_low") for f in (F.min, F.max)]
    by_anchor = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("within"), *least_most)
    mixed = (F.col("min_high") != F.col("max_high")) | (F.col("min_low") != F.col("max_low")) | F.col("within")
    busy = materialise(by_anchor.filter("n > 1 OR within").select("anchor", mixed.alias("mixed")), "anchors")
    live = materialise(each.drop("twice").join(busy, "anchor"), "segments")
    forget(busy)
    return live


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments that are asked for."""
    cutter = Cutter()
    for batch in slices(batches, "text"):
        rows = {name: [] for name in ("anchor", "high", "low", "windows", "body")}
        for text, asked in zip(batch.column("text").cast(pa.binary()), batch.column("asked"), strict=True):
            words, wanted = words_of(text.as_py()), {(s["anchor"], s["high"], s["low"]) for s in asked.as_py()}
            found = cutter.segments(words)
            ids = zip(*[_signed(found[c]).tolist() for c in SEGMENT[:3]], strict=True)
            for key, first, windows in zip(ids, found["first"].tolist(), found["windows"].tolist(), strict=True):
                if key in wanted:
                    wanted.discard(key)
                    for name, value in zip(rows, (*key, windows, b" ".join(words[first : first + windows + WINDOW - 1])), strict=True):
                        rows[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def pieces(kinds: DataFrame, once: DataFrame, texts: DataFrame) -> DataFrame:
    """``(anchor, high, low, windows, body)``: each of the segments ``kinds(anchor, high, low, rid)``, from the text of that number."""
    asked = kinds.groupBy("rid").agg(F.collect_list(F.struct("anchor", "high", "low")).alias("asked"))
    asked = materialise(asked.join(once.select("rid", "k1", "k2", "own"), "rid").drop("rid"), "asked")
    cut = texts.drop("id").join(asked, ["k1", "k2", "own"]).select("text", "asked")
    cut = cut.mapInArrow(_pieces, "anchor long, high long, low long, windows int, body binary")
    return cut.dropDuplicates(["anchor", "high", "low"])  # rows that repeat whole are cut more than once


def repeated_suffixes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the WINDOW words from each of ``starts`` on are those from another one on.

    The nodes of the suffixes' tree are named level by level: a node of twice the depth is
    the pair of names of its halves. What shares no name with another suffix at some level
    hangs from a leaf, and goes no deeper.
    """
    names, depth = np.unique(words, return_inverse=True)[1], 1
    steps = []
    while 2 * depth < WINDOW:
        steps.append(names)
        pair = names[:-depth] * (int(names.max()) + 1) + names[depth:]
        names, depth = np.unique(pair, return_inverse=True)[1], 2 * depth
    # the last WINDOW - depth words by the shortest name that reaches over them
    over = next(d for d in (2**k for k in range(len(steps))) if d >= WINDOW - depth)
    tail = steps[over.bit_length() - 1][starts + WINDOW - over]
    _, node, size = np.unique(names[starts] * (int(tail.max(initial=0)) + 1) + tail, return_inverse=True, return_counts=True)
    return size[node] > 1


#: Words of groups that are put into one tree at a time.
TOGETHER = 1 << 20


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated windows of pieces sorted by group, as runs; groups are taken together up to TOGETHER words, none is split."""
    held, size, last = [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("g", "anchor", "high", "low", "at", "windows", "body")]
        for row in zip(*columns, strict=True):
            if row[0] != last and size >= TOGETHER:
                yield _tree(held)
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += row[5] + WINDOW
        del columns
    if held:
        yield _tree(held)
    tidy()


def _tree(rows: list[tuple]) -> pa.RecordBatch:
    known: dict[bytes, int] = {}
    ids: list[int] = []
    starts, owner = [], []
    for n, row in enumerate(rows):
        starts.append(np.arange(len(ids), len(ids) + row[5]))
        owner.append(np.full(row[5], n))
        ids += [known.setdefault(w, len(known) + 1) for w in row[6].split(b" ")]
        ids.append(0)  # stands between pieces
    ids += [0] * WINDOW
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    again = repeated_suffixes(np.array(ids, np.int64), starts)
    at, owner = starts[again], owner[again]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    base = np.cumsum([0] + [len(r[6].split(b" ")) + 1 for r in rows])[owner[head]] if len(head) else np.zeros(0, np.int64)
    first = at[head] - base + np.array([rows[n][4] for n in owner[head].tolist()], np.int64)
    length = np.diff(np.append(head, len(at)))
    own = owner[head].tolist()
    columns = [pa.array([rows[n][k] for n in own], pa.int64()) for k in (1, 2, 3)] + [pa.array(first, pa.int32()), pa.array(length, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "high", "low", "at", "length"])


RUNS = "anchor long, high long, low long, at int, length int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the pieces as a piece of its own."""
    for batch in slices(batches, "body", 1 << 18):
        rows = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "high", "low", "at", "windows", "body")], strict=True):
            words = row[5].split(b" ")
            rows += [(*row[:3], row[3] + k, 1, b" ".join(words[k : k + WINDOW])) for k in range(row[4])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "high", "low", "at", "windows", "body"])


def _in_trees(group: DataFrame) -> DataFrame:
    return group.repartition("g").sortWithinPartitions("g").mapInArrow(_trees, RUNS)


def repeats(cut: DataFrame) -> DataFrame:
    """``(anchor, high, low, at, length)``: runs of windows of :func:`pieces` that repeat among them, from window ``at`` on."""
    pending = cut.withColumn("at", F.lit(0)).withColumn("g", F.col("anchor"))
    found = None
    for prefix in (*PREFIXES, None):
        sizes = pending.groupBy("g").agg(F.sum("windows").alias("suffixes"))
        large = materialise(sizes.filter(F.col("suffixes") > GROUP).select("g"), "large")
        some = _in_trees(pending.join(large, "g", "left_anti"))
        found = some if found is None else found.union(some)
        if large.isEmpty():
            return found
        rest = pending.join(large, "g", "left_semi").select("anchor", "high", "low", "at", "windows", "body")
        if prefix == PREFIXES[0]:
            rest = rest.mapInArrow(_suffixes, "anchor long, high long, low long, at int, windows int, body binary")
        if prefix:
            start = F.substring_index(F.col("body").cast("string"), " ", prefix)
            pending = materialise(rest.withColumn("g", F.xxhash64("anchor", start)), "suffixes")
        else:
            rest = rest.withColumn("w1", F.xxhash64("body")).withColumn("w2", F.xxhash64(F.lit(1), "body"))
            many = materialise(rest.groupBy("w1", "w2").count().filter("count > 1").drop("count"), "windows")
            found = found.union(rest.join(many, ["w1", "w2"], "left_semi").select("anchor", "high", "low", "at", F.lit(1).alias("length")))
    return found


def covered(spans: Column) -> Column:
    """How many words sorted ``(s, e)`` cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("until"))
    step = lambda have, x: F.struct(
        (have.n + F.greatest(x.e - F.greatest(x.s, have.until), F.lit(0))).alias("n"), F.greatest(have.until, x.e).alias("until")
    )
    return F.aggregate(spans, start, step).n


def repeated_spans(once: DataFrame, texts: DataFrame) -> DataFrame:
    """``(rid, spans)``: sorted ``(s, e)``, words from ``s`` to before ``e``, that repeated windows of a text of :func:`different` cover."""
    live = live_segments(once)
    mixed = live.filter("mixed")
    kinds = mixed.groupBy("anchor", "high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("windows").alias("length"))
    kinds = materialise(kinds, "kinds")
    cut = materialise(pieces(kinds, once, texts), "pieces")
    whole = kinds.filter("n > 1").select("anchor", "high", "low", F.lit(0).alias("at"), "length")
    runs = materialise(repeats(cut).union(whole), "runs")
    some = mixed.join(runs, ["anchor", "high", "low"]).select("rid", (F.col("first") + F.col("at")).alias("s"), "length")
    all_ = live.filter("NOT mixed").select("rid", F.col("first").alias("s"), F.col("windows").alias("length"))
    span = F.struct("s", (F.col("s") + F.col("length") + WINDOW - 1).alias("e"))
    spans = materialise(some.union(all_).groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans")), "spans")
    forget(live, kinds, cut, runs)
    return spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        digests = []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            words, kept, until = words_of(text.as_py()), [], 0
            for span in spans.as_py():
                kept += words[until : span["s"]]
                until = max(until, span["e"])
            digests.append(sha256(b" ".join(kept + words[until:])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(digests, pa.string())], names=["k1", "k2", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` of every row: its words, those that repeated windows cover, and the rest's hash.

    Null texts have no words. Rows that repeat are documents of their own, so all words of
    texts of WINDOW words or more that stand in two rows go. Ids may be null, other
    columns take no part, an empty table gives no rows.
    """
    texts = named(docs, id_col, text_col)
    once = different(texts)
    spans = repeated_spans(once, texts)
    marked = once.select("rid", "k1", "k2", "own", "n", "n_words", "digest").join(spans, "rid", "left")
    copied = F.expr(f"n > 1 AND n_words >= {WINDOW}")
    removed = F.when(copied, F.col("n_words")).when(F.col("spans").isNull(), 0).otherwise(covered(F.col("spans")))
    marked = materialise(marked.withColumn("n_removed", removed), "marked")
    partly = marked.filter("n_removed > 0 AND n_removed < n_words").select("k1", "k2", "own", "spans")
    kept = texts.drop("id").join(partly, ["k1", "k2", "own"]).select("k1", "k2", "text", "spans").mapInArrow(_kept, "k1 long, k2 long, kept string")
    kept = kept.groupBy("k1", "k2").agg(F.min("kept").alias("kept"))
    digest = F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(F.coalesce("kept", F.sha2(F.lit("").cast("binary"), 256)))
    verdict = marked.join(kept, ["k1", "k2"], "left").select("k1", "k2", "n_words", "n_removed", digest.alias("kept_sha256"))
    verdict = materialise(verdict, "verdicts")
    out = texts.select("id", "k1", "k2").join(verdict, ["k1", "k2"]).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
    return out
