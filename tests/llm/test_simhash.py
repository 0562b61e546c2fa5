import random

import numpy as np
import pytest
import xxhash

from tallyspark.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    ids = [(i, slow_fingerprint(t)) for i, t in rows]
    low = {i: i for i, _ in ids}
    changed = True
    while changed:
        changed = False
        for i, a in ids:
            for j, b in ids:
                if (a ^ b).bit_count() <= 4 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted((i, f"{f:016x}", low[i]) for i, f in ids)


def test_masks_cover_every_pair_within_the_radius():
    masks = np.array(simhash.covering_masks(), np.int64)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(1, 4))
        d = np.uint64(sum(1 << b for b in bits)).view(np.int64)
        assert ((masks & d) == 0).any()


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "One\ttwo  THREE"), (105, "É é\x0bü"), (7, "x " * 5000)]
    for k in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(120)] = rng.choice(words)
            rows.append((200 + 10 * k + c, " ".join(own)))
    return rows


def test_against_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, label int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == slow_components(rows)


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    centres = [rng.getrandbits(63) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(60), rng.randint(0, 4))) for c in centres for _ in range(60)})
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 4 for e in edges)

    def groups(pairs):
        up = {f: f for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(f) for f in fps]

    assert groups((e.u, e.v) for e in edges) == groups((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = simhash.near_duplicates(twice).collect()
    assert [r.component_id for r in got] == [3, 3, 3]


@pytest.mark.parametrize("text", ["", "a", "a b c d", "A B c d e f", "ß " * 40, "x" * 50000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)
