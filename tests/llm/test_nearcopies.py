import random
from collections import Counter

import corpus_pipeline
from tallyspark.llm import nearcopies

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(texts):
    """Smallest index of each text's group, by the similarity of all pairs that share a shingle."""
    sets, holders, shared, root = [grams(t) for t in texts], {}, Counter(), list(range(len(texts)))
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for own in holders.values():
        shared.update((a, b) for x, b in enumerate(own) for a in own[:x])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in shared.items():
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicate_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {rows[g].doc_id for g in groups([r.text for r in rows])}
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_one_row_of_each_group(spark):
    base = [f"w{i}" for i in range(100)]
    near, other = " ".join([*base[:99], "x"]), " ".join(f"v{i}" for i in range(100))
    rows = [(3, " ".join(base)), (7, near), (7, other), (7, other), (None, near.upper()), (None, "alone"), (8, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], KIND)
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([rows[0], (7, other), (None, "alone"), (8, None)])


def test_buckets_that_stay_mixed(spark, monkeypatch):
    """With one round and blocks of six texts, links come from the tasks that compare what a bucket holds apart."""
    rng = random.Random(8)
    monkeypatch.setattr(nearcopies, "ROUNDS", 1)
    monkeypatch.setattr(nearcopies, "BLOCK", 6)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(90)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want, asked = groups(texts), []
    real = nearcopies.within_buckets
    monkeypatch.setattr(nearcopies, "within_buckets", lambda apart, sets: asked.append(apart.count()) or real(apart, sets))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], KIND)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == {g for g in want} and asked and 4 < len(kept) < 100
