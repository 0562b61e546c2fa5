import math
import random
import unicodedata
from collections import Counter
from itertools import pairwise

import numpy as np

from tallyspark.llm import hashing, quality

KIND = "doc_id long, text string, quality_score string, pattern int"


def pattern_of(digits):
    return sum(int(v) * 3**k for k, v in enumerate(digits))


def test_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    k, n = len(quality.LABELLERS), 20000
    good = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.95, k)
    speaks = np.linspace(0.9, 0.5, k)
    digits = np.where(rng.random((n, k)) < right, 1 + good[:, None], 2 - good[:, None]) * (rng.random((n, k)) < speaks)
    seen = {}
    for row in digits:
        seen[pattern_of(row)] = seen.get(pattern_of(row), 0) + 1
    model = quality.fit_labels(seen)
    assert abs(model.prior - 0.8) < 0.02
    said = model.accuracy[:, 1, 2] / (model.accuracy[:, 1, 1] + model.accuracy[:, 1, 2])
    assert np.abs(said - right).max() < 0.03
    found = np.array([model.posterior(pattern_of(r)) >= 0.5 for r in digits[:2000]])
    assert (found == good[:2000]).mean() > 0.95


def test_scorer_follows_soft_targets():
    rng = np.random.default_rng(1)
    x = rng.random((500, 16)).astype(np.float32)
    y = 1 / (1 + np.exp(-(8 * x[:, 3] - 4)))
    w, b = quality.fit_scorer(x, y)
    assert np.corrcoef(x @ w + b, x[:, 3])[0, 1] > 0.95


def test_labelled_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert np.mean([r.quality_keep for r in good]) >= 0.98
    assert np.mean([not r.quality_keep for r in bad]) >= 0.95


def test_edges(spark):
    assert quality.classify(spark.createDataFrame([], KIND)).count() == 0
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat.", "dog,", "and", "ran"]) for _ in range(n))
    rows = [(i, prose(60), "x", 1) for i in range(80)] + [(200 + i, f"w{i}%%% ### " * 40, "x", 1) for i in range(20)]
    rows += [(300, None, "x", 1), (301, "", "x", 1), (302, " \n", "x", 1), (None, prose(90000), "x", 1), (1, rows[1][1], "x", 1)]
    out = quality.classify(spark.createDataFrame(rows, KIND))
    assert out.columns == ["doc_id", "text", "quality_score", "pattern", "quality_keep"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.quality_keep == (r.doc_id is None or r.doc_id < 200) for r in got)
    assert [r.quality_score for r in got if r.doc_id == 300] == [0.0]


def test_clean_texts_of_other_scripts(spark):
    hindi = "भारत एक विशाल देश है और यहाँ अनेक भाषाएँ बोली जाती हैं। लोग सुबह जल्दी उठते हैं, फिर अपने काम पर जाते हैं। बच्चे विद्यालय में पढ़ते हैं और शाम को खेलते हैं।".split()
    chinese = "今天天气很好，我们一起去公园散步。孩子们在草地上玩耍，老人坐在树下聊天。晚上回家以后，大家做饭、看书、休息。第二天早上又要去学校上课！"
    thai = "วันนี้อากาศดีมากเราจึงไปเดินเล่นที่สวนสาธารณะด้วยกัน เด็กๆเล่นอยู่บนสนามหญ้าส่วนผู้สูงอายุนั่งคุยกันใต้ต้นไม้ ตอนเย็นทุกคนกลับบ้านทำอาหารและอ่านหนังสือ"
    rng = random.Random(3)
    texts = [" ".join(rng.sample(hindi, len(hindi))) for _ in range(5)] + [chinese, thai]
    for text in texts:
        m = dict(zip(quality.MEASURES, quality.measures(text), strict=True))
        assert m["symbols"] < 0.02 and m["plain"] >= 0.9, (text, m)
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], prose.schema)
    got = quality.classify(prose.union(own)).filter("doc_id >= 1000000").collect()
    assert all(r.quality_keep for r in got), [(r.doc_id, r.quality_score) for r in got]
    assert quality.votes(quality.measures("¶¶§ ••• ‡‡‡ §§§ " * 20)) % 3 == 1


def plain_measures(text):
    """The measures once more, character by character and word by word."""
    words = quality.words_of(text)
    if not words:
        return None
    n, common = len(words), set("0123456789.,;:?'’-\"()")
    blank = sum(c in " \n\t\r" for c in text)

    def fine(c):
        kind = unicodedata.category(c)
        if c in hashing.ODD_MARKS or c == "’":
            return False
        return kind[0] in "LM" or c.isalpha() or ord(c) > 127 and (kind[0] == "P" or c.isdecimal()) or c in "\u200c\u200d"

    marks = len(text) - blank - sum(fine(c) or c in common for c in text)
    cased = sum(c.isupper() or c.islower() for c in text)
    counts = Counter(words)
    cut = [(w[:-1], w[-1]) if w[-1] in quality.STOPS else (w, "") for w in words]
    letters = sum(quality.of_letters(w) for w, _ in cut)
    bars = sum(not quality.of_letters(w) and len(w) < 4 and not any(c.isalnum() for c in w) for w, _ in cut)
    shouts, stops = sum(x in ("!", "！") for _, x in cut), sum(bool(x) for _, x in cut)
    runs = [tuple(words[i : i + 8]) for i in range(n - 7)]
    return [
        max(0, marks) / max(1, len(text) - blank),
        max(0, sum(c.isupper() for c in text) - 1) / max(1, cased),
        max(0, sum(a == b for a, b in pairwise(words)) - 1) / n,
        max(0, bars - 1) / n,
        shouts / n,
        1 - len(set(runs)) / len(runs) if n >= 64 else 0.0,
        sum(c for _, c in counts.most_common(3)) / n if n >= 20 else 0.0,
        min(n, letters + 4) / n,
        stops / n,
    ]


def plain_votes(m):
    if m is None:
        return (1,) * 9
    symbols, capitals, repeats, bars, shouts, cycles, spread, plain, stops = m
    limits = ((symbols, 0.08), (capitals, 0.5), (repeats, 0.08), (bars, 0.04), (shouts, 0.1), (cycles, 0.5), (spread, 0.75))
    prose = 2 if plain >= 0.9 and repeats <= 0.03 and spread <= 0.5 and capitals <= 0.25 else 1 if plain < 0.5 else 0
    ends = 2 if 0.02 <= stops <= 0.4 and shouts < 0.05 else 1 if stops < 0.005 and plain < 0.9 else 0
    return (*(int(x >= limit) for x, limit in limits), prose, ends)


def plain_posteriors(votes):
    """Expectation-maximisation row by row."""
    good = [0.9 if v.count(2) > v.count(1) else 0.1 for v in votes]
    for _ in range(100):
        prior = (sum(good) + 1) / (len(votes) + 2)
        table = [[[1.0] * 3, [1.0] * 3] for _ in range(9)]
        for v, g in zip(votes, good):
            for k, x in enumerate(v):
                table[k][0][x] += 1 - g
                table[k][1][x] += g
        rate = [[[x / sum(row) for x in row] for row in two] for two in table]
        odds = [math.log(prior / (1 - prior)) + sum(math.log(rate[k][1][x] / rate[k][0][x]) for k, x in enumerate(v)) for v in votes]
        good = [1 / (1 + math.exp(-max(-500, min(500, o)))) for o in odds]
    return good


def plain_features(text, m):
    """Hashed n-grams of character classes with whole numbers, and the measures' steps."""
    kinds = hashing.shapes()
    symbols, counts, mask = [int(kinds[ord(c)]) for c in text], Counter(), (1 << 64) - 1
    for at in range(len(symbols)):
        h = 0
        for k, s in enumerate(symbols[at : at + 4]):
            h = (h ^ s) * hashing.MULTIPLIERS[k] & mask
            h ^= h >> 29
            counts[(h * hashing.SPREAD & mask) >> 64 - quality.BITS] += 1
    x = np.zeros(1 << quality.BITS)
    for b, n in counts.items():
        x[b] = math.sqrt(n / max(1, counts.total()))
    for k, value in enumerate(m or []):
        step = sum(value > edge for edge in (0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.75))
        x[(k * 131 + step * 31 + 7) % len(x)] += 0.5
    return x.astype(np.float32)


def test_whole_method_against_a_plain_form(spark):
    """Measures, votes, expectation-maximisation, features, fit and score of every row, put together once more."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rows += [(900, None), (901, ""), (902, "§§ || !!!"), (None, "Some words, and some more of them. They say little."), (None, "Some words, and some more of them. They say little.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.quality_score, r.quality_keep) for r in quality.classify(docs).collect()}

    found = [plain_measures(t or "") for _, t in rows]
    posterior = plain_posteriors([plain_votes(m) for m in found])
    each = {}
    for (i, t), m, p in zip(rows, found, posterior):
        each[i, t] = (plain_features(t or "", m), p)
    x, y = np.array([f for f, _ in each.values()]), np.array([p for _, p in each.values()])
    order = np.lexsort((x[:, :64].sum(1), x.sum(1), y))
    x, y = x[order].astype(float), y[order]
    w, b, gw, gb = np.zeros(x.shape[1]), 0.0, np.full(x.shape[1], 1e-8), 1e-8
    rng = np.random.default_rng(2)
    for _ in range(30):
        turn = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            grad, bias = 1e-5 * w, 0.0
            own = turn[at : at + 32]
            for i in own:
                d = 1 / (1 + math.exp(-max(-30, min(30, float(x[i] @ w) + b)))) - y[i]
                grad, bias = grad + d * x[i] / len(own), bias + d / len(own)
            gw, gb = gw + grad**2, gb + bias**2
            w, b = w - 0.5 * grad / np.sqrt(gw), b - 0.5 * bias / math.sqrt(gb)
    for (i, t), m in zip(rows, found):
        score = 1 / (1 + math.exp(-(float(plain_features(t, m) @ w) + b))) if m else 0.0
        assert abs(got[i, t][0] - score) < 2e-3 and (abs(score - 0.5) < 2e-3 or got[i, t][1] == (score >= 0.5))


def test_sample_is_bounded_whatever_repeats(spark):
    """Null and repeated ids: every different row may be in the sample, once, and the verdicts come out right."""
    good = "The old man walked to the river, and the water was cold. He sat down there, as he did each day."
    rows = [(None, f"{good} It was day {'abcdefghij'[i % 10] * (i % 7 + 1)}.") for i in range(300)] + [(7, "|| §§ ## @@ || ^^ ~~ {} " * (i % 9 + 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id is None, r.quality_keep) for r in quality.classify(docs).collect()} == {(True, True), (False, False)}
