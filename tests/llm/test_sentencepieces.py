import random
import struct
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tallyspark.llm import sentencepieces
from tallyspark.llm.sentencepieces import Decoder, Encoder, Pieces, fields

PIECES = Pieces.load()
ENCODER, DECODER = Encoder(PIECES), Decoder(PIECES)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def as_unigram(data):
    """The model file declared to be a unigram model, with the scores used here, for the library's own Viterbi."""
    out, n_piece = b"", 0
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            value = varint(10) + varint(len(own[1])) + own[1] + varint(21) + struct.pack("<f", max(-30, PIECES.scores[n_piece]))
            value += varint(24) + varint(own.get(3, 1))
            n_piece += 1
        if number == 2:
            spec = b""
            for n, v in fields(value):
                if n == 3:
                    v = 1
                if isinstance(v, int):
                    spec += varint(n << 3) + varint(v)
                else:
                    kind = 5 if len(v) == 4 and n in (10, 15, 51) else 2
                    spec += varint(n << 3 | kind) + (v if kind == 5 else varint(len(v)) + v)
            value = spec
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def one(text):
    values, sizes = ENCODER.encode([text])
    assert sizes.tolist() == [len(values)]
    return values.tolist()


def slow(text):
    """Best path over the whole text, without cutting it into words."""
    ids = {PIECES.texts[i]: i for i in range(len(PIECES.texts)) if PIECES.kinds[i] == 1}
    s = (" " + text).replace("▁", "\ue123").replace(" ", "▁")
    least = min(PIECES.scores[i] for i in ids.values())
    best = [(0.0, 0, [])] + [None] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 32), j):
            w = s[i:j]
            if w in ids:
                c = (best[i][0] + PIECES.scores[ids[w]], i, best[i][2] + [ids[w]])
            elif j - i == 1:
                raw = "▁".encode() if w == "\ue123" else w.encode()
                c = (best[i][0] + least - 10, i, best[i][2] + [PIECES.texts.index(f"<0x{b:02X}>") for b in raw])
            else:
                continue
            if best[j] is None or c[0] > best[j][0]:
                best[j] = c
    return best[-1][2]


def words(seed, n):
    rng = random.Random(seed)
    docs = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    return [t[(at := rng.randrange(max(1, len(t) - 150))) : at + 150] for t in (rng.choice(docs) for _ in range(n))]


CASES = ["a", " ", "  ", " a", "a ", "a  b", "   a   b   ", "▁", "a▁b", "x\ny\tz", "日本語 😀 é", "\x00\x7f", "the the the"]


@pytest.mark.parametrize("text", CASES)
def test_against_brute_force_and_round_trip(text):
    assert one(text) == slow(text)
    assert DECODER.decode(pa.array([one(text)], pa.list_(pa.int32()))).to_pylist() == [text]


def test_texts_against_brute_force():
    for text in words(1, 12):
        assert one(text) == slow(text)


def test_same_as_the_library_as_unigram():
    """Without the file's scores of -1e9, beside which the library's single precision loses all others."""
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(sentencepieces.MODEL, "rb").read()))
    mine = Encoder(Pieces(PIECES.texts, np.maximum(-30, PIECES.scores), PIECES.kinds, True))
    total = lambda ids: np.maximum(-30, PIECES.scores[ids]).sum()
    same = 0
    texts = [*words(2, 300), *(c for c in CASES if "▁" not in c)]
    for text in texts:
        values, _ = mine.encode([text])
        theirs = library.encode(text)
        same += values.tolist() == theirs
        assert -1e-9 <= total(values) - total(theirs) < 1e-3 or min(theirs) < 259
    assert same >= 0.9 * len(texts)  # the others are ties


def test_memory_limit_changes_nothing(monkeypatch):
    texts = words(3, 60)
    whole = [one(t) for t in texts]
    monkeypatch.setattr(sentencepieces, "REMEMBER", 5000)
    monkeypatch.setattr(sentencepieces, "TOGETHER", 64)
    fresh = Encoder(PIECES)
    for at in range(0, 60, 7):
        values, sizes = fresh.encode(texts[at : at + 7])
        assert values.tolist() == [x for t in whole[at : at + 7] for x in t] and sizes.tolist() == [len(t) for t in whole[at : at + 7]]


def test_frames(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate([None, "", *CASES, "w" * 3000, "a " * 40000])] + [(None, "a", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    out = sentencepieces.decode(sentencepieces.encode(docs)).collect()
    assert len(out) == len(rows) and all(r.decoded == r.text for r in out)
    assert [r.ids for r in out if r.text is None] == [None] and [r.ids for r in out if r.text == ""] == [[]]
    assert sentencepieces.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([([300, None, -1, 99999, 1, 0],), (None,)], "ids array<int>")
    assert [r.decoded for r in sentencepieces.decode(odd).collect()] == [PIECES.texts[300].replace("▁", " ").removeprefix(" ") + " ⁇ ", None]


def test_long_words_against_brute_force(monkeypatch):
    """Words without spaces, of scripts and repetitions that tie, cut into chunks and spans of chunks."""
    rng = random.Random(4)
    prose = "".join(words(5, 20)).replace(" ", "")
    texts = ["a" * 700, "ab" * 333, prose, "".join(rng.choice("日本語、テキスト。ab") for _ in range(900)), " " * 400, "é😀" * 200 + "the" * 200]
    whole = [slow(t) for t in texts]
    assert [one(t) for t in texts] == whole
    monkeypatch.setattr(sentencepieces, "TOGETHER", 256)
    fresh = Encoder(PIECES)
    assert [fresh.encode([t])[0].tolist() for t in texts] == whole


def test_a_long_word_takes_time_in_proportion():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz日本語") for _ in range(300_000))
    start = time.time()
    ids = pa.array([Encoder(PIECES).encode([text])[0]], pa.list_(pa.int32()))
    assert DECODER.decode(ids).to_pylist() == [text]
    assert time.time() - start < 20


def test_check_of_the_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *CASES])], "doc_id long, text string")
    assert all(r.ok for r in sentencepieces.encode(docs, check_col="ok").collect())
