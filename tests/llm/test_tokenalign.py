import random
from collections import Counter
from hashlib import sha256

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tallyspark.llm import tokenalign

A = Tokenizer.from_file(tokenalign.BYTE_LEVEL)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=tokenalign.MODEL)
KIND = "doc_id long, text string, id int, block int, pair int, ids string"


def bytes_of_a(i):
    names = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in names.values()]
    names |= {chr(256 + n): b for n, b in enumerate(rest)}
    return bytes(names[c] for c in A.id_to_token(i))


def bytes_of_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def slow_groups(text):
    """Of the whole text, encoded in one go: [(ids of A, ids of B)]."""
    if not text:
        return []
    sides = []
    for ids, get in ((A.encode(" " + text, add_special_tokens=False).ids, bytes_of_a), (B.encode(text), bytes_of_b)):
        parts = [get(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return []
        at, ends = 0, []
        for p in parts:
            at += len(p)
            ends.append(at)
        sides.append(list(zip(ids, ends, strict=True)))
    both = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    place = {end: n for n, end in enumerate(both)}
    groups = [([], []) for _ in both]
    for k, side in enumerate(sides):
        at = 0
        for i, e in side:
            groups[at][k].append(i)
            at += e in place
    return groups


def slow(rows):
    groups = [slow_groups(t) for _, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    held = Counter(p for own in links for p in own)
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        n_best = sum(n for p, n in own.items() if held[p] == best[p[0]])
        total = sum(n * held[p] for p, n in own.items())
        counts = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()))
        out.append((doc_id, *counts, n_best, total, sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], KIND).repartition(parts)
    return sorted(map(tuple, tokenalign.align(docs).collect()), key=str)


TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a",
    " lead and trail ",
    "two  spaces   three",
    "line\nline\n \n end \n",
    "tabs\t \there\r\n x",
    "▁ a literal mark ▁",
    "x▁y",
    "<|endoftext|> <s> </s> <unk> <0x41> it's we'll",
    "naïve façade — “quoted” … Ωμέγα русский 中文字符 日本語 한국어 🙂🙂 é",
    " nbsp em　wide   x\u0085 y",
    "\x00nul \x1f\x1c sep ​ zero ﻿ bom ᠎ mvs x",
    "1234567890 3.14159 1,000,000",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
    "def f(x):\n    return x  # comment\n\n\n\n",
]


def test_against_brute_force(spark):
    rng = random.Random(12)
    alphabet = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "é", "中", "▁", "'s", "1", " ", " ", "🙂", ".", "-"]
    rows = [(n, t) for n, t in enumerate(TEXTS)]
    rows += [(100 + n, "".join(rng.choices(alphabet, k=rng.randint(1, 60)))) for n in range(150)]
    rows += [(300 + n, "".join(rng.choices([x for x in alphabet if x != "▁"], k=rng.randint(1, 90)))) for n in range(300)]
    rows += [(7, "a"), (7, "a"), (None, "the thing"), (None, None)]
    want = slow(rows)
    assert got(spark, rows) == want
    assert sum(r[1] > 0 for r in want) > 300


def test_blocks_and_forgotten_words_change_nothing(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    want = slow(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(tokenalign, "BLOCK", 1 << 10)
    known = tokenalign.Known(tokenalign.tokenizers(tokenalign.BYTE_LEVEL, tokenalign.MODEL))
    monkeypatch.setattr(tokenalign, "WORDS", 50)
    for doc_id, text in rows:
        known.learn(known.of.words(text))
        words = [known.groups[known.number[w]].decode() for w in known.of.words(text)]
        own = next(r for r in want if r[0] == doc_id)
        assert sha256(";".join(words).encode()).hexdigest() == own[-1]


def test_long_text_without_spaces(spark):
    rows = [(1, "abcd中" * 20000), (2, "x" * 100000)]
    assert got(spark, rows, 1) == slow(rows)


def test_groups_as_text(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.groups for r in tokenalign.groups(docs).collect()}
    for n, t in rows:
        assert out[n] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in slow_groups(t))


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("label", range(3))
def test_spans(label):
    import numpy as np

    rng = random.Random(label)
    ends = [sorted({rng.randint(1, 40) for _ in range(12)} | {40}) for _ in range(2)]
    want = sorted(set(ends[0]) & set(ends[1]))
    assert tokenalign.spans(np.array(ends[0]), np.array(ends[1]), 40).tolist() == want


def test_byte_level_names():
    assert ByteLevel().decode([A.id_to_token(i) for i in A.encode(" é\n").ids]) == " é\n"
