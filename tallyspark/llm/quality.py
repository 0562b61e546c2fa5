"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every text. How often each
pattern of votes occurs, over all texts, is all that expectation-maximisation
needs to estimate the labellers' accuracies and each pattern's posterior.
Posteriors are the targets of a logistic scorer on hashed n-grams of
character classes, and that scorer judges.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import STANDS_FOR, cased, code_points, gram_counts, shapes, upon_letters, written
from .shared import forget, materialise, of_text, slices

#: About how many different texts the scorer is fitted on; the driver holds their hashed counts.
SAMPLE = 4000
BITS = 12
ORDERS = (1, 2, 3, 4)
#: Mixes the words of a run.
RUN_BASE = 0x9E3779B97F4A7C1
#: Marks that end a sentence or clause.
STOPS = frozenset(".,;:!?…") | frozenset(STANDS_FOR)
#: Letters of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, Tibetan, kana, Han), which come without them here.
_UNSPACED = "\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0ebd-\u0ec6\u0f40-\u0f6c\u1000-\u102a\u1780-\u17b3\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_UNSPACED}]")
#: Where a letter begins that counts as a word.
UNSPACED_EDGE = re.compile(f"(?=[{_UNSPACED}])")


def words_of(text: str) -> list[str]:
    """Words by white space; letters of scripts without it are words of their own, with the marks behind them."""
    return (UNSPACED_EDGE.sub(" ", text) if not text.isascii() and UNSPACED.search(text) else text).split()


def of_letters(word: str) -> bool:
    """Whether a word is letters and marks upon them."""
    return word.isalpha() or not word.isascii() and word.translate(upon_letters()).isalpha()


#: What measures() gives, in its order.
MEASURES = ("symbols", "capitals", "repeats", "bars", "shouts", "cycles", "spread", "plain", "stops")
#: Each votes bad from its limit on and is silent below it.
BAD_FROM = {"symbols": 0.08, "capitals": 0.5, "repeats": 0.08, "bars": 0.04, "shouts": 0.1, "cycles": 0.5, "spread": 0.75}
LABELLERS = (*BAD_FROM, "prose", "sentences")


def measures(text: str) -> list[float] | None:
    """The labellers' measures of a whole text; None if it has no words."""
    words = words_of(text)
    if not words:
        return None
    n = len(words)
    points = code_points(text)
    has_case = int(cased()[points].sum())
    upper = int((shapes()[points] == ord("A")).sum())
    blank = sum(map(text.count, " \n\t\r"))
    plain = int(written()[points].sum()) + blank + sum(map(text.count, "0123456789.,;:?'’-\"()"))
    counts = Counter(words)
    bars = shouts = worded = stops = 0
    for w, c in counts.items():
        last = w[-1]
        if last in STOPS:
            stops += c
            shouts += c * (last in "!！")
            w = w[:-1]
        if of_letters(w):
            worded += c
        elif len(w) < 4 and not any(map(str.isalnum, w)):
            bars += c
    ids = np.fromiter(map(hash, words), np.int64, n)
    run = np.zeros(max(0, n - 7), np.int64)
    if n >= 64:
        for k in range(8):
            run = (run * RUN_BASE) ^ ids[k : n - 7 + k]
    return [
        max(0, len(text) - plain) / max(1, len(text) - blank),  # marks other than common ones, of all characters but white space
        max(0, upper - 1) / max(1, has_case),  # upper case but for one, of letters that have case
        max(0, int((ids[1:] == ids[:-1]).sum()) - 1) / n,  # words equal to the word before, but for one
        max(0, bars - 1) / n,  # words without letter or digit, but for one
        shouts / n,  # words that end in an exclamation mark
        1 - len(np.unique(run)) / (n - 7) if n >= 64 else 0.0,  # runs of eight words seen before in the text
        sum(c for _, c in counts.most_common(3)) / n if n >= 20 else 0.0,  # the three commonest words
        min(n, worded + 4) / n,  # words of letters and a last mark, and four
        stops / n,  # words that end in a sentence mark
    ]


def votes(found: list[float] | None) -> int:
    """One base-3 digit for each labeller: 0 silent, 1 bad, 2 good; all bad for a text without words."""
    if found is None:
        return sum(3**k for k in range(len(LABELLERS)))
    m = dict(zip(MEASURES, found, strict=True))
    cast = [int(m[name] >= limit) for name, limit in BAD_FROM.items()]
    prose = m["plain"] >= 0.9 and m["repeats"] <= 0.03 and m["spread"] <= 0.5 and m["capitals"] <= 0.25
    cast.append(2 if prose else 1 if m["plain"] < 0.5 else 0)
    cast.append(2 if 0.02 <= m["stops"] <= 0.4 and m["shouts"] < 0.05 else 1 if m["stops"] < 0.005 and m["plain"] < 0.9 else 0)
    return sum(v * 3**k for k, v in enumerate(cast))


@dataclass
class LabelModel:
    prior: float
    #: P(vote | class) by labeller, class (bad, good) and vote (silent, bad, good)
    accuracy: np.ndarray

    def log_odds(self, digits: np.ndarray) -> np.ndarray:
        """Of good against bad, for rows of votes."""
        k = np.arange(len(LABELLERS))
        told = np.log(self.accuracy[k, 1, digits]) - np.log(self.accuracy[k, 0, digits])
        return np.clip(np.log(self.prior / (1 - self.prior)) + told.sum(-1), -500, 500)

    def posterior(self, pattern: int) -> float:
        """P(good | votes)."""
        digits = np.array([pattern // 3**k % 3 for k in range(len(LABELLERS))])
        return float(1 / (1 + np.exp(-self.log_odds(digits))))


def fit_labels(patterns: dict[int, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over pattern counts, from the majority of votes; a tie is bad at first.

    Of each labeller it estimates how often it votes good, bad or nothing on good
    and on bad texts, so its silence counts as well.
    """
    k = len(LABELLERS)
    seen = np.array(list(patterns), np.int64)
    n = np.array(list(patterns.values()), float)
    digits = np.array([seen // 3**j % 3 for j in range(k)]).T.reshape(-1, k)
    good = np.where((digits == 2).sum(1) > (digits == 1).sum(1), 0.9, 0.1)
    model = LabelModel(0.5, np.full((k, 2, 3), 1 / 3))
    for _ in range(rounds if len(seen) else 0):
        weight = np.stack([n * (1 - good), n * good])
        table = 1.0 + np.array([[weight @ (digits[:, j] == v) for v in range(3)] for j in range(k)]).transpose(0, 2, 1)
        model = LabelModel(float((weight[1].sum() + 1) / (n.sum() + 2)), table / table.sum(2, keepdims=True))
        good = 1 / (1 + np.exp(-model.log_odds(digits)))
    return model


def features(text: str, found: list[float] | None) -> np.ndarray:
    """Hashed features of a whole text: square roots of the shares of its n-grams of character classes, and its measures in steps.

    Letters are two classes by case, digits one, stops of all scripts the ASCII ones; other characters stand for themselves.
    """
    counts = gram_counts(shapes()[code_points(text)], ORDERS, BITS)
    x = np.sqrt(counts / max(1, counts.sum()))
    for k, value in enumerate(found or []):
        step = int(np.searchsorted((0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.75), value))
        x[(k * 131 + step * 31 + 7) % len(x)] += 0.5
    return x.astype(np.float32)


def fit_scorer(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.5, l2: float = 1e-5, seed: int = 2):
    """Logistic regression on soft targets by AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    gw, gb = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            own = order[at : at + 32]
            d = 1 / (1 + np.exp(-np.clip(x[own] @ w + b, -30, 30))) - y[own]
            g, h = x[own].T @ d / len(own) + l2 * w, d.mean()
            gw += g * g
            gb += h * h
            w -= rate * g / np.sqrt(gw)
            b -= rate * h / np.sqrt(gb)
    return w, b


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        pattern, at, value = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = measures(text)
            x = features(text, found)
            nz = np.flatnonzero(x)
            pattern.append(votes(found))
            at.append(nz.astype(np.int16))
            value.append(x[nz])
        yield pa.RecordBatch.from_arrays(
            [pa.array(pattern, pa.int32()), pa.array(at, pa.list_(pa.int16())), pa.array(value, pa.list_(pa.float32()))],
            names=["pattern", "at", "value"],
        )


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """P(good), by the hashed linear scorer; 0 for a text without words."""
        found = measures(text or "")
        if found is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(text, found) @ self.weights + self.bias, -30, 30))))


def train(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Scorer:
    """Vote patterns are counted over all texts; the scorer is fitted on about ``sample`` of them, by a hash of id and text.

    Rows equal in id and text count as one in the sample, so that its size is bounded
    whatever repeats; how many differ is estimated in the pass that counts the votes.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(92)).alias("row"))
    pattern = of_text("int", pa.int32(), lambda t: votes(measures(t or "")), F.col("text"))
    counted = texts.select(pattern.alias("pattern"), "row").groupBy("pattern")
    counted = materialise(counted.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("row").alias("rows")), "votes")
    found = counted.collect()  # at most 3**9
    forget(counted)
    labels = fit_labels({r["pattern"]: r["n"] for r in sorted(found)})
    share = F.pmod("row", F.lit(1_000_003)) < F.lit(1_000_003 * sample / max(1, sum(r["rows"] for r in found)))
    got = (
        texts.filter(share)
        .dropDuplicates(["row"])
        .select("text")
        .mapInArrow(_sampled, "pattern int, at array<short>, value array<float>")
        .toArrow()
    )
    x = np.zeros((got.num_rows, 1 << BITS), np.float32)
    for row, (at, value) in enumerate(zip(got.column("at"), got.column("value"), strict=True)):
        x[row, at.values.to_numpy()] = value.values.to_numpy()
    y = np.array([labels.posterior(p) for p in got.column("pattern").to_pylist()])
    order = np.lexsort((x[:, :64].sum(1), x.sum(1), y)) if len(x) else np.empty(0, int)  # not as it arrived
    w, b = fit_scorer(x[order], y[order])
    return Scorer(labels, w, b)


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with its own columns and rows, and ``quality_score`` (0 to 1) and ``quality_keep``.

    Null texts and texts without words score 0 and are not kept. Rows that repeat
    stay. An empty table gives no rows. Columns of ``docs`` that have the names of the
    two new ones give way to them.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, sample))

    scored = docs.withColumn("quality_score", of_text("double", pa.float64(), lambda t: scorer.value.score(t), F.col(text_col)))
    return scored.withColumn("quality_keep", F.col("quality_score") >= threshold)
