import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import mixing


def slow_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]} - full
        if not over:
            return sizes, target
        full |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(800):
        source = rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"])
        n = rng.choice([0, 1, 5, 40, 300])
        rows.append((i, None if n == 0 and i % 2 else " \n".join(["w"] * n), source))
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, source string, key int, h string"
    )
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes, target = slow_targets(rows)
    by = {i: (t, s) for i, t, s in rows}
    taken = Counter()
    for r in got:
        text, source = by[r.doc_id]
        assert r.size == len((text or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source]) and r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 150.5
    rows_out = mixing.mixed_rows(docs)
    assert rows_out.columns == docs.columns
    copies = Counter(r.doc_id for r in rows_out.collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got)


def test_edges(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", "a")], kind)).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0), (0, 0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], kind)).collect()
    assert all(r.target == 6 and r.taken <= 4 for r in one)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: None if i % 2 else i])
def test_repeated_ids_and_rows(spark, ids):
    """Rows that repeat, by id or whole, are taken one by one, and the mix is made of the same rows."""
    rows = [(ids(i), "w " * 10 if i % 3 else f"v{i} " * 4, "a") for i in range(300)]
    rows += [(1000 + i, "x " * 3, "b") for i in range(100)] + [(1500 + i, "y y", "c") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    _, target = slow_targets(rows)
    for s, n in (("a", 2400), ("b", 300), ("c", 3000)):
        own = [r for r in got if r.source_size == n]
        assert abs(sum(r.taken for r in own) - target[s]) <= 5.5 and all(r.taken <= 2 * r.size for r in own)
    copies = Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed_rows(docs).collect())
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.size] += r.taken // r.size
    assert copies == +taken


def test_water_fill_with_many_rounds(spark):
    caps = [(float(w), float(c)) for w, c in zip(range(1, 9), (1, 2, 3, 50, 60, 70, 800, 900), strict=True)]
    got = mixing.water_fill(spark.createDataFrame(caps, "weight double, cap double"), 1000.0).collect()
    assert sum(r.target for r in got) == pytest.approx(1000) and all(r.target <= r.cap for r in got)
    free = {round(r.target / r.weight, 9) for r in got if r.target < r.cap}
    assert len(free) <= 1
