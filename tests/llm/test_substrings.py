import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tallyspark.llm import substrings

KIND = "doc_id long, text string, rid int, k1 int, own string, spans int"
W = substrings.WINDOW


def slow(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + W]) for w in texts for i in range(len(w) - W + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(words) - W + 1):
            if seen[tuple(words[i : i + W])] > 1:
                gone.update(range(i, i + W))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], KIND).repartition(parts)
    return sorted(map(tuple, substrings.dedup(docs).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "中", "a\xa0b", "x y"]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [fresh(n) for n in (34, 35, 36, 50, 70, 140)]
    out = [None, "", " \n\t ", "one", " ".join(fresh(34)), "x " * 34, "y " * 36, "z " * 300, "a b " * 90, "p q r " * 11 + "s " + "p q r " * 14]
    for k in range(40):
        parts = [fresh(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), fresh(rng.randint(0, 40))]
        out.append(rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p))
    base = fresh(200)
    for k in range(30):  # near copies, some of them exact
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = rng.choice(words)
        out.append(" ".join(own))
    out += [" ".join(fresh(120))] * 3 + ["\n".join(base)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert got(spark, rows) == slow(rows)


@pytest.mark.parametrize("group", [0, 3, 40])
def test_large_groups_are_split_by_prefixes(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = list(enumerate(texts(3)))
    assert got(spark, rows) == slow(rows)


def test_null_and_repeated_ids_and_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage + " one"), (None, passage + " two"), (4, "short"), (4, "short"), (5, passage), (5, passage), (6, f"x {passage}"), (6, f"x {passage}")]
    assert got(spark, rows) == slow(rows)


def test_empty_table_and_nothing_repeated(spark):
    assert got(spark, []) == []
    rows = [(1, " ".join(f"a{i}" for i in range(90))), (2, " ".join(f"b{i}" for i in range(90)))]
    assert got(spark, rows) == slow(rows)


def test_repeated_suffixes():
    rng = random.Random(4)
    words = [rng.randrange(2) for _ in range(30)] * 4 + [rng.randrange(3) for _ in range(200)] + [1] * 80
    starts = np.arange(len(words))
    seen = Counter(tuple(words[i : i + W]) for i in starts if i + W <= len(words))
    ids = np.array([w + 1 for w in words] + [0] * W)
    keep = starts[: len(words) - W + 1]
    assert substrings.repeated_suffixes(ids, keep).tolist() == [seen[tuple(words[i : i + W])] > 1 for i in keep]


def test_segments_of_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    cutter = substrings.Cutter()
    shared = [b"s%d" % rng.randrange(9) for _ in range(50)]
    anchors = []
    for _ in range(20):
        before = [b"b%d" % rng.randrange(9) for _ in range(rng.randint(0, 80))]
        found = cutter.segments(before + shared + before[::-1])
        of_window = np.repeat(found["anchor"], found["windows"].astype(np.int64))
        anchors.append(of_window[len(before) : len(before) + 50 - W + 1].tolist())
    assert all(x == anchors[0] for x in anchors)
