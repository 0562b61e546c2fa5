"""Alignment of two tokenizers over the same text: groups of tokens that cover the same bytes, and how often ids are linked.

Of a text's bytes each has a label: a token of A ends with it, one of B, both, or
none. A regular expression scans the labels for spans up to each "both"; the labels
counted within a span say how many tokens of either side the group has.

Neither tokenizer joins a space to what stands before it, so a text falls apart at
spaces after other characters, and each different word is encoded, labelled and
scanned once in a task. Documents are dealt with in blocks of about BLOCK bytes. A
block remembers its texts as numbers of its words, and its words as counts of id
pairs; the pairs of a block, each once, are what is shuffled to count documents
corpus-wide, and the counts come back to the blocks the same way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import MODEL, SPACE
from .shared import forget, materialise, slices, tidy

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of texts of a block, but for one longer text.
BLOCK = 1 << 20
#: Words, and bytes of them, that a task remembers from one block to the next.
WORDS, WORD_BYTES = 300_000, 32 << 20
#: Bits of an id of B in an id pair.
SHIFT = 20
_label = np.frombuffer(b".abx", np.uint8)
_span = re.compile(rb"[^x]*x")
_cut = re.compile(r"(?<=\S)(?= )")
_odd = re.compile(r"[^\S ] |  ")


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """The tokenizer A of ``byte_level`` and B of ``pieces``, each with its tokens' bytes."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        value = _byte_values()
        names = (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        self.a_bytes = [bytes(value[c] for c in name) if all(c in value for c in name) else name.encode() for name in names]
        size = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(size)
        ]
        self.space = self.b.piece_to_id(SPACE)
        #: Whether no piece of B goes on with a space after another character.
        self.cuts = not any(re.search(rf"[^{SPACE}]{SPACE}", self.b.id_to_piece(i)) for i in range(size))
        texts = [f"{i}{end}" for end, n in ((",", len(self.a_bytes)), ("|", len(self.a_bytes)), (",", size), (";", size)) for i in range(n)]
        self.written = pa.array(texts, pa.binary())

    def words(self, text: str) -> list[str]:
        """The text cut where a space follows another character; each word stands for a space and itself."""
        if not self.cuts:
            return [text]
        if text[0] != " " and text[-1] != " " and not _odd.search(text):
            return text.split(" ")
        return [w[1:] for w in _cut.split(" " + text)]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        b = self.b.encode(words, num_threads=1)
        return [x.ids for x in a], [y if w else [self.space] for w, y in zip(words, b, strict=True)]


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def spans(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> np.ndarray:
    """The ends of the spans of ``size`` bytes that end where a token of A and one of B end."""
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] |= 1
    labels[b_ends - 1] |= 2
    return np.fromiter((m.end() for m in _span.finditer(_label[labels].tobytes())), np.int64)


def _all(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum())), sizes


def _expanded(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group and the id pair of every link of groups of ``n_a`` and ``n_b`` tokens each."""
    links = n_a * n_b
    group = np.repeat(np.arange(len(links)), links)
    place = np.arange(len(group)) - np.repeat(links.cumsum() - links, links)
    first_a, first_b, wide = (n_a.cumsum() - n_a)[group], (n_b.cumsum() - n_b)[group], n_b[group]
    return group, a[first_a + place // wide] << SHIFT | b[first_b + place % wide]


@dataclass
class Known:
    """What a task remembers of words: token counts, groups as text, and id pairs with how often they are linked."""

    of: Tokenizers
    number: dict[str, int] = field(default_factory=dict)
    groups: list[bytes] = field(default_factory=list)
    #: Of each word: tokens of A, of B, groups, links, and whether both sides give its bytes.
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), np.int64))
    #: Of each word where its pairs end in ``pairs`` and ``times``.
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: int = 0

    def learn(self, words: list[str]) -> None:
        t = self.of
        if len(self.number) > WORDS or self.size > WORD_BYTES:
            self.__init__(t)
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if not new:
            return
        self.size += sum(map(len, new))
        texts = [(" " + w).encode("utf-8", "surrogatepass") for w in new]
        ids_a, ids_b = t.encode(new)
        whole = [b"".join([t.a_bytes[i] for i in x]) == s == b"".join([t.b_bytes[i] for i in y]) for s, x, y in zip(texts, ids_a, ids_b, strict=True)]
        for n, ok in enumerate(whole):
            if not ok:
                texts[n], ids_a[n], ids_b[n] = b"", [], []
        (a, per_a), (b, per_b) = _all(ids_a), _all(ids_b)
        ends = np.fromiter(map(len, texts), np.int64, len(texts)).cumsum()
        sizes_a, sizes_b = (np.array([len(x) for x in own], np.int64) for own in (t.a_bytes, t.b_bytes))
        ends_a, ends_b = sizes_a[a].cumsum(), sizes_b[b].cumsum()
        found = spans(ends_a, ends_b, int(ends[-1]))
        until_a, until_b = np.searchsorted(ends_a, found, "right"), np.searchsorted(ends_b, found, "right")
        n_a, n_b = np.diff(until_a, prepend=0), np.diff(until_b, prepend=0)
        word = np.searchsorted(ends, found, "left")
        links = n_a * n_b
        # tokens in the order in which they are written: group by group, A's and then B's
        starts = (n_a + n_b).cumsum() - n_a - n_b
        of_a, of_b = np.repeat(np.arange(len(found)), n_a), np.repeat(np.arange(len(found)), n_b)
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.arange(len(a)) == until_a[of_a] - 1, np.arange(len(b)) == until_b[of_b] - 1
        order[starts[of_a] + np.arange(len(a)) - (until_a - n_a)[of_a]] = a + len(sizes_a) * last_a
        order[starts[of_b] + n_a[of_b] + np.arange(len(b)) - (until_b - n_b)[of_b]] = 2 * len(sizes_a) + b + len(sizes_b) * last_b
        written = t.written.take(pa.array(order))
        offsets = np.frombuffer(written.buffers()[1], np.int32, len(written) + 1)
        data = written.buffers()[2].to_pybytes() if len(written) else b""
        cuts = offsets[np.concatenate(([0], (per_a + per_b).cumsum()))].tolist()
        self.groups += [data[x : y - 1] if y > x else b"" for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        group, pair = _expanded(a, b, n_a, n_b)
        key, times = _counted(word[group], pair)
        per_word = [np.bincount(word, w, len(new)).astype(np.int64) for w in (np.ones(len(word)), links)]
        self.counts = np.concatenate([self.counts, np.stack([per_a, per_b, *per_word, np.array(whole, np.int64)], 1)])
        base = self.ends[-1] if len(self.ends) else 0
        self.ends = np.concatenate([self.ends, base + np.bincount(key[0], minlength=len(new)).cumsum()])
        self.pairs, self.times = np.concatenate([self.pairs, key[1]]), np.concatenate([self.times, times])
        for w in new:
            self.number[w] = len(self.number)


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The different pairs of values, in order, and how often each occurs."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return (first[at], second[at]), np.diff(np.append(at, len(first)))


def _cut_into_blocks(byte_level: str, pieces: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(tokenizers(byte_level, pieces))
        for batch in slices(batches, "text", BLOCK):
            if batch.num_rows:
                yield _block(known, batch)
        tidy()

    return made


def _numbers(known: Known, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts one after the other, and where each text's end; a text that either side does not give back has none."""
    words = [known.of.words(t) if (t := x.as_py()) else [] for x in texts]
    known.learn([w for own in words for w in own])
    get = known.number.__getitem__
    own = [np.fromiter(map(get, x), np.int64, len(x)) for x in words]
    own = [x if known.counts[x, 4].all() else x[:0] for x in own]
    return np.concatenate([np.zeros(0, np.int64), *own]), np.fromiter(map(len, own), np.int64, len(own)).cumsum()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of the runs of ``values`` that end at ``ends``."""
    return np.diff(np.concatenate(([0], values.cumsum()))[ends], prepend=0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each start and the numbers after it, as many as its size."""
    return np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 0 or more in as few bytes each as the largest takes, after a byte that says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _block(known: Known, batch: pa.RecordBatch) -> pa.RecordBatch:
    numbers, ends = _numbers(known, batch.column("text"))
    words, place = np.unique(numbers, return_inverse=True)
    counts = known.counts[words, :4]
    totals = [_sums(counts[place, k], ends) for k in range(4)]
    starts = np.concatenate(([0], known.ends))[words]
    sizes = known.ends[words] - starts
    at = _ranges(starts, sizes)
    pairs, of_word = np.unique(known.pairs[at], return_inverse=True)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    (in_doc, word), _ = _counted(doc, place)
    links = of_word[_ranges((sizes.cumsum() - sizes)[word], sizes[word])]
    held = np.bincount(_counted(np.repeat(in_doc, sizes[word]), links)[0][1], minlength=len(pairs))
    digests, before = [], 0
    for end in ends.tolist():
        own = numbers[before:end].tolist()
        digests.append(sha256(b";".join([known.groups[i] for i in own])).hexdigest() if own else "")
        before = end
    as_row = lambda values, kind: pa.array([values], pa.list_(kind))
    as_bytes = lambda values: pa.array([_packed(values)], pa.binary())
    columns = {"ids": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))}
    columns |= {name: as_row(x, pa.int64()) for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), totals, strict=True)}
    columns |= {"digests": as_row(digests, pa.string()), "pairs": as_row(pairs, pa.int64()), "held": as_row(held, pa.int64())}
    columns |= {"ends": as_bytes(ends), "words": as_bytes(place), "sizes": as_bytes(sizes), "links": as_bytes(of_word), "times": as_bytes(known.times[at])}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' documents, with the counts of their links summed."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield _documents(batch.slice(n, 1))
        tidy()


def _documents(block: pa.RecordBatch) -> pa.RecordBatch:
    get = lambda name: _unpacked(block.column(name)[0].as_py())
    ends, words, sizes, links, times = map(get, ("ends", "words", "sizes", "links", "times"))
    found = block.column("found")[0].values  # of the pairs in order
    sums = []
    for name in ("best", "documents"):
        each = found.field(name).to_numpy(zero_copy_only=False).astype(np.int64) if found is not None else np.zeros(0, np.int64)
        sums.append(_sums(_sums(times * each[links], sizes.cumsum())[words], ends))
    own = [block.column(name)[0].values for name in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")]
    own[5:5] = [pa.array(x, pa.int64()) for x in sums]
    return pa.RecordBatch.from_arrays(own, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = MODEL) -> DataFrame:
    """Documents in blocks: their token counts, their words by number, and each pair of the block with how many of its documents hold it."""
    kind = docs.schema[id_col].dataType.simpleString()
    many = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, pairs array<bigint>, held array<bigint>"
    schema = f"ids array<{kind}>, {many}, ends binary, words binary, sizes binary, links binary, times binary"
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut_into_blocks(byte_level, pieces), schema)
    return cut.withColumn("block", F.monotonically_increasing_id())


def pair_counts(cut: DataFrame) -> DataFrame:
    """``(pair, documents, best)``: how many documents hold each pair of :func:`blocks`, and whether none of the same id of A is held by more."""
    each = cut.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("documents"))
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT))
    counts = materialise(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # as many rows as A has ids
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = MODEL) -> DataFrame:
    """Per document its tokens of A and B, groups and links, the links' counts, and the digest of its groups.

    ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``. Texts that
    are null or empty, or that the tokens of either side do not give back, have no
    tokens: zeros and an empty digest. Rows that repeat are documents of their own, ids
    may be null, an empty table gives no rows, other columns take no part.
    """
    cut = materialise(blocks(docs, id_col, text_col, byte_level, pieces), "blocks")
    counts = materialise(pair_counts(cut), "counts")
    asked = cut.select("block", F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "documents", "best"))).alias("found"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    told = cut.drop("pairs", "held").join(answers, "block", "left")
    return told.mapInArrow(_judged, schema).withColumnRenamed("id", id_col)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = MODEL) -> DataFrame:
    """``(id, groups)``: each document's groups as ``a1,a2|b1;a3|b2,b3``, the ids of A and of B; empty without tokens."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(tokenizers(byte_level, pieces))
        for batch in slices(batches, "text", BLOCK):
            numbers, ends = _numbers(known, batch.column("text"))
            own = [b";".join([known.groups[i] for i in x.tolist()]).decode() for x in np.split(numbers, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.string())], names=["id", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(written, f"id {kind}, groups string").withColumnRenamed("id", id_col)
