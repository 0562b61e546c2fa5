import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import hashing, langid
from tallyspark.llm.hashing import code_points, gram_counts


def test_gram_counts_do_not_depend_on_the_parts(monkeypatch):
    points = code_points("häuser und straßen, 日本語 😀 " * 40)
    whole = gram_counts(points, (1, 2, 3), 10)
    monkeypatch.setattr("tallyspark.llm.hashing.PART", 17)
    assert (gram_counts(points, (1, 2, 3), 10) == whole).all()
    assert whole.sum() == 3 * len(points) - 3


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(400):
        k = i % 3
        at = np.sort(np.concatenate(([k], 3 + rng.choice(200, 20, replace=False))))
        rows.append((at, np.full(21, 21**-0.5)))
        y.append(k)
    w, b = langid.fit_ftrl(rows, np.array(y), 203, 3, l1=0.5)
    assert (np.argmax(w[:3], axis=1) == [0, 1, 2]).all() and (w == 0).mean() > 0.3
    right = [np.argmax(x @ w[at] + b) == k for (at, x), k in zip(rows, y, strict=True)]
    assert np.mean(right) > 0.95


def test_temperature():
    rng = np.random.default_rng(2)
    p = langid.softmax(rng.normal(0, 2, (4000, 3)))
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.fit_temperature(5 * np.log(p), y) == pytest.approx(5, rel=0.15)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


KIND = "doc_id long, text string, lang string, at int, label string"


def test_edges(spark):
    assert langid.identify(spark.createDataFrame([], KIND)).count() == 0
    rows = [(i, "the cat and the dog " if i % 2 else "le chat et le chien ", "en" if i % 2 else "fr", 1, "x") for i in range(60)]
    rows += [(100, None, "en", 1, "x"), (101, "123 !?", "fr", 1, "x"), (102, "", None, 1, "x"), (None, "chat " * 9000, None, 1, "x"), (None, "dog", None, 1, "x")]
    got = langid.identify(spark.createDataFrame(rows, KIND)).collect()
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert len(got) == 65 and by[100] == by[101] == by[102] == "und" and by[1] == "en" and by[2] == "fr"
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["en", "fr"]
    bare = langid.identify(spark.createDataFrame([(1, "text", None, 1, "x")], KIND)).collect()
    assert [(r.lang_pred, r.score) for r in bare] == [("und", 0.0)]


def plain_counts(text):
    """n-gram buckets by whole numbers; None without a letter."""
    said = "".join(c if c.isalpha() else " " for c in text.lower())
    if not said.strip():
        return None
    symbols, counts, mask = [ord(c) for c in f" {' '.join(said.split())} "], Counter(), (1 << 64) - 1
    for at in range(len(symbols)):
        h = 0
        for k, s in enumerate(symbols[at : at + 3]):
            h = (h ^ s) * hashing.MULTIPLIERS[k] & mask
            h ^= h >> 29
            counts[(h * hashing.SPREAD & mask) >> 64 - langid.BITS] += 1
    return counts


def plain_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_whole_method_against_a_plain_form(spark):
    """TF-IDF, FTRL with both penalties coordinate by coordinate, temperature and prediction of every row, put together once more."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90).collect()
    rows = [(r.doc_id, (r.text or "")[:300], r.lang) for r in table] + [(900, None, "en"), (901, "123 !", "en"), (902, "ça va bien", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    counts = {i: plain_counts(t) if t is not None else None for i, t, _ in rows}
    learned = [(i, label) for i, t, label in rows if not held[i] and label is not None and counts[i]]
    df = Counter(b for i, _ in learned for b in counts[i])
    idf = lambda b: math.log((1 + len(learned)) / (1 + df[b])) + 1 if df[b] else 0.0

    def vector(i):
        x = {b: math.log1p(n) * idf(b) for b, n in sorted(counts[i].items())}
        size = max(math.sqrt(sum(v * v for v in x.values())), 1e-12)
        return {b: v / size for b, v in x.items()}

    examples = [(vector(i), label) for i, label in learned]
    key = lambda e: (np.array(list(e[0]), np.int64).tobytes(), np.array(list(e[0].values())).tobytes(), e[1])
    # sums of squares may round otherwise than in numpy, so the order is taken from the buckets and labels
    examples.sort(key=lambda e: (key(e)[0], e[1]))
    classes = sorted({label for _, label in examples})
    spare, fit = examples[::5], [e for k, e in enumerate(examples) if k % 5]
    z, n, bias = {}, {}, "bias"

    def weight(b, c):
        zz, root = z.get((b, c), 0.0), math.sqrt(n.get((b, c), 0.0))
        if b == bias:
            return -zz / (1.0 + root)
        return 0.0 if abs(zz) <= 1e-3 else -math.copysign(abs(zz) - 1e-3, zz) / (1.0 + root + 1e-3)

    def logits(x):
        return [sum(v * weight(b, c) for b, v in x.items()) + weight(bias, c) for c in range(len(classes))]

    rng = np.random.default_rng(9)
    for _ in range(3):
        for k in rng.permutation(len(fit)):
            x, label = fit[k]
            p = plain_softmax(logits(x))
            p[classes.index(label)] -= 1
            for b, v in [*x.items(), (bias, 1.0)]:
                for c in range(len(classes)):
                    g, old = v * p[c], n.get((b, c), 0.0)
                    sigma = math.sqrt(old + g * g) - math.sqrt(old)
                    z[b, c] = z.get((b, c), 0.0) + g - sigma * weight(b, c)
                    n[b, c] = old + g * g
    loss = lambda t: sum(-math.log(max(plain_softmax([q / t for q in logits(x)])[classes.index(y)], 1e-12)) for x, y in spare)
    temperature = min(np.geomspace(0.02, 20, 121), key=loss)
    for i, t, _ in rows:
        assert got[i].held_out == held[i]
        if not counts[i]:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = plain_softmax([q / temperature for q in logits(vector(i))])
        assert abs(got[i].score - max(p)) < 1e-4 and (got[i].lang_pred == classes[p.index(max(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-4)
