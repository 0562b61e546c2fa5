"""SentencePiece encoding and decoding: batched numpy Viterbi over the words of many texts.

Scores of a unigram model are log-probabilities and are used as they are. Those of
a BPE model are only the negative ranks of its merges; here they become
log-probabilities by a power law of the rank, with a fixed cost for each piece.
The ids are then the best path under these scores. They decode to the text, but
are not always those of the merges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 of a text, which no piece may match lest it be decoded as a space.
OUTSIDE = 0x110001
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BASE = 0x9E3779B97F4A7C15
#: The cost of a piece of a BPE model is this and the logarithm of its rank.
PIECE_COST = 6.0
#: Bits by which a hash is shifted to ask whether any piece's begins alike, before it is looked up.
LIKELY = np.uint64(44)
#: Scores are rounded to multiples of this, so that sums, and ties of them, are exact in any order.
GRAIN = 2.0**-20
#: Bytes, about, of the distinct words that a task remembers from one batch to the next, and what each takes besides its characters.
REMEMBER, OVERHEAD = 32 << 20, 128
#: Characters of words of one length that advance together.
TOGETHER = 1 << 16
#: Words of more characters are cut into chunks, and the chunks advance together.
LONG = 128
CHUNK = 64
#: Bytes of texts that a task cuts into words at a time, but for one longer text.
AT_A_TIME = 4 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Pieces:
    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        texts, scores, kinds, prefix, merges = [], [], [], True, False
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    piece = dict(fields(value))
                    texts.append(piece[1].decode())
                    scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    kinds.append(piece.get(3, NORMAL))
                elif number == 2:
                    merges = dict(fields(value)).get(3, 1) == 2
                elif number == 3:
                    prefix = bool(dict(fields(value)).get(3, 1))
        scores = np.array(scores)
        if merges:
            scores = np.where(scores > -1e8, -PIECE_COST - np.log(3 + np.maximum(0, -scores)), scores)
        return cls(texts, np.round(scores / GRAIN) * GRAIN, np.array(kinds), prefix)


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Encoder:
    """Best segmentation of texts into pieces by the sum of the pieces' scores.

    A character that no piece covers becomes the pieces of its UTF-8 bytes. Pieces
    never reach over the start of a word, so words are solved apart: words of
    equal length together, position by position, and among equal sums the piece
    that starts first. A long word is cut into chunks that advance together too.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = np.flatnonzero(pieces.kinds == NORMAL)
        lengths = np.array([len(pieces.texts[i]) for i in usable])
        self.longest = int(lengths.max(initial=1))
        power = powers(self.longest)
        keys = np.zeros(len(usable), np.uint64)
        for n, i in enumerate(usable):
            points = np.frombuffer(pieces.texts[i].encode("utf-32-le"), np.uint32).astype(np.uint64)
            keys[n] = (points * power[: len(points)][::-1]).sum(dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.lengths = keys[order], usable[order].astype(np.int32), lengths[order]
        self.key_scores = pieces.scores[self.ids]
        self.likely = np.zeros(1 << 64 - int(LIKELY), bool)
        self.likely[keys >> LIKELY] = True
        self.unknown = pieces.scores[usable].min(initial=0.0) - 10
        self.byte_ids = {int(pieces.texts[i][3:5], 16): int(i) for i in np.flatnonzero(pieces.kinds == BYTE)}
        self.unknown_id = int(np.flatnonzero(pieces.kinds == UNKNOWN)[0]) if (pieces.kinds == UNKNOWN).any() else 0
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words."""
        self.place: dict[str, int] = {}
        self.flat, self.sizes, self.held = np.empty(0, np.int32), np.empty(0, np.int64), 0

    def _matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words (rows) of one length, (scores, ids) of the pieces that end at each position, from the widest to one character.

        A substring's hash is looked up among the sorted keys of the pieces. A
        character that no piece covers scores as unknown and has id -1 - its code point.
        """
        n, size = points.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        np.cumsum(points * powers(size - 1, pow(BASE, -1, 1 << 64)), axis=1, out=prefix[:, 1:])
        power = powers(size)
        scores = np.full((n, size, self.longest), -np.inf)
        ids = np.zeros((n, size, self.longest), np.int32)
        scores[:, :, -1], ids[:, :, -1] = self.unknown, -1 - points.astype(np.int64)
        for width in range(1, min(self.longest, size) + 1):
            key = (prefix[:, width:] - prefix[:, : size + 1 - width]) * power[width - 1 : size]
            row, start = np.nonzero(self.likely[key >> LIKELY])
            key = key[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.lengths[at] == width)
            row, end, at = row[hit], start[hit] + width - 1, at[hit]
            scores[row, end, self.longest - width], ids[row, end, self.longest - width] = self.key_scores[at], self.ids[at]
        return scores, ids

    def _solve(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (rows) of one length -> (ids, sizes); an uncovered character is id -1 - its code point."""
        n, size = points.shape
        scores, ids = self._matches(points)
        best = np.full((n, self.longest + size), -np.inf)
        best[:, self.longest - 1] = 0
        choice = _advance(best, scores)
        rows = np.arange(n)
        piece = ids[rows[:, None], np.arange(size)[None, :], choice]
        width = self.longest - choice
        out = np.zeros((n, size), np.int32)
        sizes = np.zeros(n, np.int64)
        at, live = np.full(n, size), rows
        while len(live):
            sizes[live] += 1
            out[live, size - sizes[live]] = piece[live, at[live] - 1]
            at[live] -= width[live, at[live] - 1]
            live = live[at[live] > 0]
        used = np.arange(size)[None, :] >= size - sizes[:, None]
        return out[used], sizes

    def _solve_long(self, points: np.ndarray) -> np.ndarray:
        """Ids of one long word, the same as :meth:`_solve` gives.

        What a chunk adds to the best sums before it is a matrix under maximum and
        sum: one row for each of the last positions at which a path may come in. All
        chunks work theirs out together; then the sums before each chunk follow one
        from another, and all chunks advance once more, from their own sums.
        """
        size, reach = len(points), self.longest
        step = max(CHUNK, reach)
        span = step * max(1, TOGETHER // step)
        widths, pieces = np.empty(size, np.int32), np.empty(size, np.int32)
        before = np.full(reach, -np.inf)
        before[-1] = 0
        for at in range(0, size, span):
            back = min(at, reach - 1)
            end = min(size, at + span)
            scores, ids = (x[0, back:] for x in self._matches(points[None, at - back : end]))
            own = end - at
            chunks = -(-own // step)
            padded = np.full((chunks * step, reach), -np.inf)
            padded[:own] = scores
            padded = padded.reshape(chunks, step, reach)
            entry = np.full((chunks, reach, reach + step), -np.inf)
            entry[:, np.arange(reach), np.arange(reach)] = 0
            for j in range(step):
                entry[:, :, reach + j] = (entry[:, :, j : j + reach] + padded[:, None, j]).max(2)
            best = np.full((chunks, reach + step), -np.inf)
            for c in range(chunks):
                best[c, :reach] = before
                before = (before[:, None] + entry[c, :, step:]).max(0)
            del entry
            choice = _advance(best, padded).reshape(-1)[:own]
            widths[at:end] = reach - choice
            pieces[at:end] = ids[np.arange(own), choice]
        out, at, widths, pieces = [], size, widths.tolist(), pieces.tolist()
        while at:
            out.append(pieces[at - 1])
            at -= widths[at - 1]
        return np.array(out[::-1], np.int32)

    def _bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces, or the unknown piece where the model has none."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, sizes
        spelt = []
        for point in (-1 - ids[bare]).tolist():
            char = SPACE if point == OUTSIDE else chr(point)
            spelt.append([self.byte_ids.get(b, self.unknown_id) for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id])
        width = np.ones(len(ids), np.int64)
        width[bare] = list(map(len, spelt))
        out = np.repeat(ids, width)
        first = width.cumsum() - width
        for at, own in zip(first[bare].tolist(), spelt, strict=True):
            out[at : at + len(own)] = own
        return out, np.add.reduceat(width, sizes.cumsum() - sizes)

    def _learn(self, words: list[str]) -> None:
        """Solve words not met before, and remember them. A word stands for itself with one space before it."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w) + 1, []).append(w)
        flat, sizes, count = [self.flat], [self.sizes], len(self.sizes)
        for length, same in sorted(by.items()):
            step = max(1, TOGETHER // length) if length <= LONG else 1
            for at in range(0, len(same), step):
                part = same[at : at + step]
                text = " " + " ".join(part)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                points = np.where(points == ord(SPACE), OUTSIDE, np.where(points == 32, ord(SPACE), points)).astype(np.uint64)
                if length <= LONG:
                    ids, n = self._bytes(*self._solve(points))
                else:
                    ids = self._solve_long(points[0])
                    ids, n = self._bytes(ids, np.array([len(ids)]))
                flat.append(ids.astype(np.int32))
                sizes.append(n)
                self.place.update(zip(part, range(count, count + len(part)), strict=True))
                count += len(part)
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.held += sum(map(len, words)) + OVERHEAD * len(words)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text; null and empty texts have none."""
        words, counts = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.place]
        if self.held and self.held + sum(map(len, new)) + OVERHEAD * len(new) > REMEMBER:
            self.forget()
            new = distinct
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        n = self.sizes[at]
        first = (self.sizes.cumsum() - self.sizes)[at]
        ends = n.cumsum()
        values = self.flat[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))]
        total = np.concatenate(([0], ends))[counts.cumsum()]
        return values, np.diff(total, prepend=0)


def _advance(best: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Fill ``best`` position by position from its first columns; the place of the first largest sum at each is returned."""
    rows = np.arange(len(best))
    reach = scores.shape[2]
    choice = np.empty(scores.shape[:2], np.int8 if reach < 128 else np.int32)
    for j in range(scores.shape[1]):
        sums = best[:, j : j + reach] + scores[:, j]
        own = sums.argmax(1)
        choice[:, j] = own
        best[:, reach + j] = sums[rows, own]
    return choice


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and how many each text has.

    A text is cut before each space that follows another character; each part goes
    without its first space, the first part with none to lose.
    """
    parts = pc.split_pattern(texts, " ")
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
    counts[pc.fill_null(pc.binary_length(texts), 0).to_numpy() == 0] = 0
    if not len(counts):
        return pa.array([], pa.string()), counts
    words = parts.filter(pa.array(counts > 0)).flatten()
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not blank.any():
        return words, counts
    row = np.repeat(np.arange(len(counts)), counts)
    last = np.concatenate((row[1:] != row[:-1], [True]))
    kept = ~blank | last
    place = np.flatnonzero(kept)
    spaces = np.diff(place, prepend=-1) - 1
    words = words.filter(pa.array(kept))
    odd = np.flatnonzero(spaces)
    longer = [" " * n + w for n, w in zip(spaces[odd].tolist(), words.take(pa.array(odd)).to_pylist(), strict=True)]
    return pc.replace_with_mask(words, pa.array(spaces > 0), pa.array(longer, pa.string())), np.bincount(row[kept], minlength=len(counts))


class Decoder:
    """Ids to text; any encoder's ids of a model, not only the best segmentation's."""

    def __init__(self, pieces: Pieces):
        spelt = []
        for text, kind in zip(pieces.texts, pieces.kinds.tolist(), strict=True):
            if kind == BYTE:
                spelt.append(bytes([int(text[3:5], 16)]))
            else:
                spelt.append(b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode())
        spelt.append(b"")
        self.size = len(spelt)
        #: What each id spells, nothing for others, and then the same without a leading space.
        self.spelt = [*spelt, *(x[x[:1] == b" " :] for x in spelt)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Ids outside the model, and nulls among them, are skipped; bytes that are no UTF-8 become U+FFFD; one leading space goes."""
        flat = ids.flatten()
        own = flat.fill_null(-1).to_numpy().astype(np.int64)
        own = np.where((own >= 0) & (own < self.size - 1), own, self.size - 1)
        ends = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64).cumsum()
        starts = np.concatenate(([0], ends[:-1]))
        lengths = np.fromiter(map(len, self.spelt), np.int64)
        told = np.append(np.flatnonzero(lengths[own] > 0), len(own))
        first = told[np.searchsorted(told, starts)]
        own[first[first < ends]] += self.size
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(self.spelt, pa.binary()).take(pa.array(own)))
        raw = pc.if_else(pa.array(ids.is_valid()), pc.binary_join(lists, b""), None)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encode(
    docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, check_col: str | None = None
) -> DataFrame:
    """``docs`` with its own columns and rows, and the piece ids of ``text_col`` as ``ids_col``, an array of int.

    A null text has null ids, an empty one none. A column that has the new one's name
    gives way to it. The model must put a space before the text, as most do. With
    ``check_col``, that column says whether the ids decode to the text again, which
    the same pass finds out.
    """
    pieces = Pieces.load(model)
    if not pieces.dummy_prefix:
        raise ValueError("the model adds no dummy prefix")
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.BooleanType()) for c in [check_col] if c]
    shared = docs.sparkSession.sparkContext.broadcast((Encoder(pieces), Decoder(pieces) if check_col else None))
    rest = [c for c in docs.columns if c not in (ids_col, check_col)]
    names = [*rest, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value
        try:
            for batch in slices(batches, text_col, AT_A_TIME):
                texts = batch.column(text_col)
                values, sizes = encoder.encode(texts)
                offsets = pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=texts.is_null())
                columns = [*(batch.column(c) for c in rest), ids]
                if decoder:
                    same = pc.fill_null(pc.equal(decoder.decode(ids), texts), False)
                    columns.append(pc.or_(same, texts.is_null()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            encoder.forget()
            tidy()

    schema = T.StructType([*(f for f in docs.schema if f.name in rest), *new])
    return docs.select(*dict.fromkeys([*rest, text_col])).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` and the text of ``ids_col`` as ``text_col``; null ids give a null text."""
    decoder = rows.sparkSession.sparkContext.broadcast(Decoder(Pieces.load(model)))

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        return decoder.value.decode(ids)

    return rows.withColumn(text_col, text(F.col(ids_col).cast("array<int>")))
