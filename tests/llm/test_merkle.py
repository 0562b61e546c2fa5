import random
import zlib
from hashlib import sha256

import pytest

from tallyspark.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf int, proof string, place int, tree int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def tree(nodes):
    """The last node, and each node's levels of (before, after)."""
    proofs, level = [[] for _ in nodes], [(x, [i]) for i, x in enumerate(nodes)]
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for run in runs:
            for k, (_, below) in enumerate(run):
                for i in below:
                    proofs[i].append(("".join(x for x, _ in run[:k]), "".join(x for x, _ in run[k + 1 :])))
        level = [(h("".join(x for x, _ in run)), [i for _, below in run for i in below]) for run in runs]
    return level[0][0], proofs


def slow(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0], leaf(*r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        own[s] = tree([x[2] for x in sources[s]])
    root, upper = tree([own[s][0] for s in order]) if order else ("", [])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, doc_id, node, r), proof in zip(sources[s], own[s][1], strict=True):
            whole = proof + above
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[1] is not None
            back = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if bad else node
            for left, right in whole:
                back = h(left + back + right)
            text = "".join(a + b for a, b in whole)
            out.append((doc_id, node, own[s][0], root, h(text), back, back == root))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], KIND).repartition(parts)
    made = merkle.manifest(docs)
    proof = merkle.digest(merkle.siblings(made.proof))
    picked = made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")
    return sorted(map(tuple, picked.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 300])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "one", "a\nb\n", "é\n" * 50, "\n", "x y\r\n" * rng.randint(1, 9)])
        source = rng.choice([None, "", "a", "B", "é", "-", "=", "hot", "hot", "hot"])
        rows.append((i * 7, text, rng.choice([None, "en", ""]), source, rng.choice([None, 0, -3, 10**12])))
    want = slow(rows)
    assert got(spark, rows) == want
    assert n < 300 or {r[-1] for r in want} == {True, False}


def test_one_source_of_many_rows(spark):
    rows = [(i, f"text {i}\n", "en", "only", i) for i in range(1000)]
    assert got(spark, rows) == slow(rows)


def test_null_and_repeated_ids_and_rows(spark):
    rows = [(None, "a\nb", "en", "s", 3)] * 4 + [(5, "same\n", None, None, 1)] * 5 + [(5, f"t{i}", "en", "s", i) for i in range(4)]
    want = slow(rows)
    assert got(spark, rows) == want == got(spark, rows[::-1], 1)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_any_change_of_a_document_is_found(spark):
    rows = [(i, "a\nb" if i % 3 else "ab", "en", "s" if i % 2 else "t", 3) for i in range(40)]
    for r in got(spark, rows):
        touched = zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[0] % 3
        assert r[-1] == (not touched)
