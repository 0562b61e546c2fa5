"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import code_points, gram_counts, letters
from .shared import of_text, slices

BITS = 14
ORDERS = (1, 2, 3)
#: About how many different labelled texts the classifier is fitted on; the driver holds their n-gram counts.
SAMPLE = 3000


def counts_of(text: str | None) -> np.ndarray | None:
    """n-gram counts of the lower-cased text with every run of other characters than letters as one space; None without letters."""
    points = code_points((text or "").lower())
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    symbols = np.where(is_letter, points, 32)
    keep = np.ones(len(symbols), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    return gram_counts(np.concatenate(([32], symbols[keep], [32])), ORDERS, BITS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets hit and their TF-IDF weights, of length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text)
        if counts is None or not self.classes:
            return "und", 0.0
        at, x = weighted(counts, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows, y, size: int, classes: int, epochs=3, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-3, seed=9):
    """Follow-the-regularised-leader: per-coordinate rates, weights solved from the summed gradients under both penalties.

    The last coordinate is the bias, which no penalty holds.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    rng = np.random.default_rng(seed)

    def solve(at):
        zz, shrunk = z[at], np.abs(z[at]) - l1
        w = np.where(shrunk > 0, -np.sign(zz) * shrunk / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)
        if len(at) and at[-1] == size:
            w[-1] = -zz[-1] / ((beta + np.sqrt(n[size])) / alpha)
        return w

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(size + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows that trained nothing; 1 if there are none."""
    if not len(y):
        return 1.0
    tried = np.geomspace(0.02, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def held_out(id_: Column) -> Column:
    """crc32 of the id as text is divisible by 5; so counts a null id, which is never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(True))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in slices(batches, "text"):
        for text in batch.column(0):
            counts = counts_of(text.as_py())
            if counts is not None:
                total += counts > 0
                texts += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], names=["gram", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        labels, ats, values = [], [], []
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            counts = counts_of(text.as_py())
            if counts is not None:
                at = np.flatnonzero(counts)
                labels.append(label.as_py())
                ats.append(at.astype(np.int16))
                values.append(np.minimum(counts[at], 32767).astype(np.int16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.string()), pa.array(ats, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.int16()))],
            names=["label", "at", "n"],
        )


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """Document frequencies come from all rows of ``labelled``; weights and temperature from about ``sample`` of them, by a hash of id, text and label.

    Rows equal in these three count as one in the sample, so that its size is bounded
    whatever repeats. A fifth of the sample sets the temperature only.
    """
    rows = labelled.select(
        F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col, text_col, label_col, F.lit(91)).alias("row")
    )
    different = rows.agg(F.approx_count_distinct("row")).first()[0]
    df = {r["gram"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    texts = df.pop(-1, 0)
    idf = np.zeros(1 << BITS)
    for gram, n in df.items():
        idf[gram] = np.log((1 + texts) / (1 + n)) + 1
    share = F.pmod("row", F.lit(1_000_003)) < F.lit(1_000_003 * sample / max(1, different))
    got = rows.filter(share).dropDuplicates(["row"]).select("text", "label").mapInArrow(_sample_counts, "label string, at array<short>, n array<short>").toArrow()
    labels = got.column("label").to_pylist()
    classes = sorted(set(labels))
    if not classes:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    examples = []
    for at, n in zip(got.column("at"), got.column("n"), strict=True):
        counts = np.zeros(1 << BITS, np.int64)
        counts[at.values.to_numpy()] = n.values.to_numpy()
        examples.append(weighted(counts, idf))
    y = np.array([classes.index(x) for x in labels])
    order = sorted(range(len(y)), key=lambda i: (examples[i][0].tobytes(), examples[i][1].tobytes(), labels[i]))  # not as it arrived
    spare = set(order[::5]) if len(order) >= 20 else set()
    fit = [i for i in order if i not in spare]
    w, b = fit_ftrl([examples[i] for i in fit], y[fit], 1 << BITS, len(classes))
    held = sorted(spare)
    logits = np.array([examples[i][1] @ w[examples[i][0]] + b for i in held]).reshape(-1, len(classes))
    return Model(classes, idf, w.astype(np.float32), b, fit_temperature(logits, y[held]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` for every row of ``docs``.

    Learns from rows that are not held out and have a label. A null text, or one
    without a letter, is ``und`` with score 0, as is every text if there is nothing to
    learn from. Rows that repeat stay; an empty table gives no rows; other columns are
    ignored.
    """
    labelled = docs.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, id_col, text_col, label_col, sample))

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(text: str | None) -> dict:
        return dict(zip(("lang_pred", "score"), model.value.predict(text), strict=True))

    told = of_text("lang_pred string, score double", kind, predict, F.col(text_col))
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), told.alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")
