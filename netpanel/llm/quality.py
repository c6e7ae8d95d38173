"""Quality by a linear classifier on n-gram indicators scaled by Naive Bayes.

Each document is a set of hashed indicators: its words and word pairs, and the one- to
three-grams of its words' shapes (case, digits, punctuation, repetition of the word
before), the shapes also by how frequent they are. Indicators are scaled by their class
log-count ratio, and a linear hinge-loss model is fitted by dual coordinate descent. A
fifth of the sample stays out of that fit and turns margins into probabilities.

The sample is bounded: at most SAMPLE labelled rows, those of least hash, and of these as
many as have SAMPLE_INDICATORS together (a row has DIMENSIONS at most, however long its
text), so one task can hold it and it is the same on every run; every row is scored. Defined cases: null and empty texts have
no indicators and score as the bias says; a null label is not learned from; a doc_id
with several labels counts with each; without two classes in the sample every score is
the share of label 1 (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, discard, map_texts, materialize, mix64, rolling

#: Labelled rows that the classifier is fitted on, and indicators of them all together, at most.
SAMPLE, SAMPLE_INDICATORS = 12_000, 1 << 25
DIMENSIONS = 1 << 18
#: Smoothing of the class counts, cost of the hinge loss, passes over the sample.
ALPHA, COST, EPOCHS = 1.0, 0.05, 12
THRESHOLD = 0.3


def _shape(w: Words, h: np.ndarray) -> np.ndarray:
    """A small code for each word: case, digits, punctuation within and at the end, repetition."""
    b = w.buf

    def each(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(b) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[w.ends] - c[w.starts]

    n = w.ends - w.starts
    upper = each((b >= 65) & (b <= 90))
    lower = each(((b >= 97) & (b <= 122)) | (b >= 128))
    digit = each((b >= 48) & (b <= 57))
    punct = n - upper - lower - digit
    last = b[w.ends - 1]
    before = b[np.maximum(w.ends - 2, w.starts)]

    def is_punct(x: np.ndarray) -> np.ndarray:
        return (x < 48) | ((x > 57) & (x < 65)) | ((x > 90) & (x < 97)) | ((x > 122) & (x < 128))

    tail = np.where(is_punct(last), last, 0).astype(np.int64) * 2 + (is_punct(last) & is_punct(before) & (n > 1))
    case = np.where(lower == 0, np.where(upper > 0, 2, 3), np.where(upper > 1, 1, 0))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    return (((tail * 4 + case) * 2 + (digit > 0)) * 3 + np.minimum(punct, 2)) * 2 + again


def indicators(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct indicators (uint32) of each text."""
    w = Words(texts, lower=False)
    low = Words(texts, lower=True)
    h = low.hashes()
    shape = _shape(w, h)
    s = mix64(shape.astype(np.uint64) + np.uint64(1 << 40))
    streams = [h, rolling(h, 2), s, rolling(s, 2), rolling(s, 3)]
    lengths = [1, 2, 1, 2, 3]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        parts = [x[a : max(a, b - k + 1)] for x, k in zip(streams, lengths, strict=True)]
        code, n = np.unique(parts[3], return_counts=True)
        level = np.round(np.log2((n + 1) / (b - a + 1)) * 2).astype(np.int64)
        parts.append(mix64(code + level.astype(np.uint64)))
        salted = [(p ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) % np.uint64(DIMENSIONS) for i, p in enumerate(parts)]
        out.append(np.unique(np.concatenate(salted)).astype(np.uint32))
    return out


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, DIMENSIONS), ALPHA)
    for x, label in zip(rows, y.tolist(), strict=True):
        counts[label, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for min 1/2 |w|^2 + cost * sum hinge; the last weight is the bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    scale = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    square = [float(v @ v) + 1.0 for v in scale]
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], scale[i]
            slope = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    return np.append(w, bias)


def margins(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """weights: log-count ratio times fitted weight of each indicator, then the bias."""
    return np.array([weights[x].sum() / np.sqrt(max(len(x), 1)) for x in rows]) + weights[-1]


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * m + b))), by Newton steps on the smoothed log loss."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step /= max(1.0, float(np.abs(step).max()) / 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights ready for margins(), then a and b of the calibration."""
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        return np.concatenate([np.zeros(DIMENSIONS + 1), [1.0, np.log(p / (1 - p))]])
    out = np.arange(len(y)) % 5 == 4
    if len(set(y[out].tolist())) < 2 or len(set(y[~out].tolist())) < 2:
        out = np.zeros(len(y), bool)
    ins = [r for r, o in zip(rows, out, strict=True) if not o]
    ratio = log_count_ratios(ins, y[~out])
    w = descend(ins, y[~out], ratio)
    weights = np.append(ratio * w[:-1], w[-1])
    test = out if out.any() else ~out
    m = margins([r for r, o in zip(rows, test, strict=True) if o], weights)
    return np.concatenate([weights, calibrate(m, y[test])])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, indicators_bound: int = SAMPLE_INDICATORS) -> np.ndarray:
    """Fits in one task on at most ``sample`` rows; what reaches the driver is the weights."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    )  # at most ``sample`` rows of two numbers: small enough to broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def scan(parts: Iterator) -> Iterator[dict]:
        for ids, ys, texts in parts:
            yield {"doc_id": ids, "y": ys, "x": [x.astype("<u4").tobytes() for x in indicators(texts)]}

    rows = materialize(map_texts(known, scan, "doc_id long, y int, x binary", ("doc_id", "y", "text")), "sample")
    sample_table = rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("x"))  # over the bounded sample's keys
    keys = rows.select("doc_id", "y", F.xxhash64("x").alias("key"), F.length("x").alias("n"), F.sum(F.length("x")).over(order).alias("upto"))
    kept = keys.where(F.col("upto") <= 4 * indicators_bound).select("doc_id", "y", "key").distinct()
    rows = rows.withColumn("key", F.xxhash64("x")).join(F.broadcast(kept), ["doc_id", "y", "key"]).drop("key")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y"])
        w = train([np.frombuffer(x, "<u4") for x in pdf["x"]], pdf["y"].to_numpy())
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "w binary").first()
    discard(sample_table)
    return np.frombuffer(found["w"], "<f4").astype(float) if found else train([], np.empty(0, int))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scan(parts: Iterator) -> Iterator[dict]:
        w = sent.value
        a, b = float(w[-2]), float(w[-1])
        for ids, texts in parts:
            m = margins(indicators(texts), w[:-2])
            yield {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))}

    return map_texts(docs, scan, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels that are not held out."""
    scored = score(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
