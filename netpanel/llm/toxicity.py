"""Toxicity by a linear classifier on character n-grams scaled by Naive Bayes.

A document's words are its runs of ASCII letters and digits and of all characters beyond
ASCII, lower-cased. A feature is a hashed run of SIZES characters of a word with a blank
before and after it; its value is the number of places that have it in the document's
distinct words, so that a word said a thousand times counts once. Features are scaled by their class
log-count ratio (toxic against other documents), and a linear hinge-loss model without
length normalisation is fitted by dual coordinate descent: a few toxic words weigh as much
in a long text as in a short one. Features that few sample documents hold, or whose ratio
is near 0, are left out. Margins of fits on all FOLDS of the sample but one, taken on that
one, turn margins into probabilities.

A document's margin is a sum over its distinct words, so scoring computes the n-grams of
each distinct word of a batch once.

The sample is bounded: at most SAMPLE labelled rows, those of least hash, and of these as
many as have SAMPLE_GRAMS features together, so one task can hold it and it is the same
on every run; every row is scored, over its whole text. Defined cases: null and empty
texts and texts without words have no features and score as the bias says; a null label or
doc_id is not learned from; a doc_id with several labels or texts counts with each; without
two classes in the sample every score is the share of label 1 (0.5 without labels); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_ALPHANUMERIC, Words, discard, distinct_at, map_texts, materialize, ranges, rolling
from .quality import calibrate

#: Labelled rows that the classifier is fitted on, and features of them all together, at most.
SAMPLE, SAMPLE_GRAMS = 12_000, 1 << 25
#: Characters of an n-gram; cells that n-grams are hashed to.
SIZES, DIMENSIONS = (3, 4, 5, 6), 1 << 20
#: Smoothing of the class counts; sample documents that must hold a feature; least size of its log ratio.
ALPHA, MIN_DOCS, MIN_RATIO = 1.0, 3, 0.5
#: Cost of the hinge loss, passes over the sample, folds of the calibration.
COST, EPOCHS, FOLDS = 0.1, 12, 4
THRESHOLD = 0.7


class Grams:
    """The distinct words of each text of a batch and the n-grams of each of these words.

    doc, word: for each distinct word of a text the text and the word's index; cells,
    owner: the hashed n-grams of all these words and the index of the word of each."""

    def __init__(self, texts: list[str | None]) -> None:
        w = Words([None if t is None else t.lower() for t in texts], gaps=NOT_ALPHANUMERIC)
        h = w.hashes()
        order = np.argsort(h, kind="stable")
        new = distinct_at(h[order])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        where = order[new]
        n = max(len(where), 1)
        pairs = np.sort(np.repeat(np.arange(len(texts)), np.diff(w.first)) * n + which)
        pairs = pairs[distinct_at(pairs)]
        self.n, self.doc, self.word = len(where), pairs // n, pairs % n
        lengths = w.ends[where] - w.starts[where]
        raw = np.full(int(lengths.sum()) + len(where) + 1, 32, np.uint8)  # a blank before each word and at the end
        at = np.arange(1, len(where) + 1) + np.cumsum(lengths) - lengths
        raw[ranges(at, lengths)] = w.buf[ranges(w.starts[where], lengths)]
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        upto = np.concatenate([[0], np.cumsum(chars == 32)])
        cells, owner = [], []
        for k in SIZES:
            g = rolling(chars, k)
            inside = np.flatnonzero(upto[k - 1 : k - 1 + len(g)] == upto[1 : len(g) + 1])  # no blank but at the ends
            cells.append(((g[inside] ^ np.uint64(k)) & np.uint64(DIMENSIONS - 1)).astype(np.int64))
            owner.append(upto[inside + 1] - 1)  # the word after the last blank up to the first character
        self.cells, self.owner = np.concatenate(cells), np.concatenate(owner)

    def rows(self, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cells, values) of each text."""
        out = []
        cells = self.cells[np.argsort(self.owner, kind="stable")]
        held = np.bincount(self.owner, minlength=self.n)
        first = np.cumsum(held) - held
        limits = np.searchsorted(self.doc, np.arange(texts + 1))
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            words = self.word[a:b]
            found = np.sort(cells[ranges(first[words], held[words])])
            at = np.flatnonzero(distinct_at(found))
            out.append((found[at], np.diff(np.append(at, len(found)))))
        return out

    def margins(self, weights: np.ndarray, texts: int) -> np.ndarray:
        words = np.bincount(self.owner, weights=weights[self.cells], minlength=self.n)
        return np.bincount(self.doc, weights=words[self.word], minlength=texts)


def log_count_ratios(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Of the shares of toxic and of other documents that hold each feature; 0 where it is not used."""
    counts = np.zeros((2, DIMENSIONS))
    for (x, _), label in zip(rows, y.tolist(), strict=True):
        counts[label, x] += 1
    shares = (counts + ALPHA) / (np.bincount(y, minlength=2)[:, None] + 2 * ALPHA)
    ratio = np.log(shares[1] / shares[0])
    return np.where((counts.sum(axis=0) >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO), ratio, 0.0)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for min 1/2 |w|^2 + cost * sum hinge over rows (cells, values); the last weight is the bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    square = [float(v @ v) + 1.0 for _, v in rows]
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i]
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


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weight of each feature (its ratio times its fitted weight), then the bias."""
    ratio = log_count_ratios(rows, y)
    used = [(x[keep], c[keep] * ratio[x[keep]]) for x, c in rows for keep in [ratio[x] != 0]]
    w = descend(used, y)
    return np.append(ratio * w[:-1], w[-1])


def row_margins(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return np.array([float(weights[x] @ c) for x, c in rows]) + weights[-1]


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights and bias, then a and b of the calibration."""
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return np.concatenate([np.zeros(DIMENSIONS + 1), [1.0, np.log(p / (1 - p))]])
    weights = fit_rows(rows, y)
    fold = np.empty(len(y), int)
    for label in (0, 1):  # each fold has its share of either class
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    margins = row_margins(rows, weights)
    for k in range(FOLDS):
        ins, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(out) and len(set(y[ins].tolist())) == 2:
            margins[out] = row_margins([rows[i] for i in out], fit_rows([rows[i] for i in ins], y[ins]))
    return np.concatenate([weights, calibrate(margins, y)])


def packed(cells: np.ndarray, values: np.ndarray) -> bytes:
    """Gaps between cells, then values, compressed: bytes are what the sample costs on its way."""
    return zlib.compress(np.concatenate([np.diff(cells, prepend=0), values]).astype("<u4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :].astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, grams_bound: int = SAMPLE_GRAMS) -> np.ndarray:
    """Fits in one task on at most ``sample`` rows; what reaches the driver is the weights."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    )  # at most ``sample`` rows of two numbers: small enough to broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def scan(parts: Iterator) -> Iterator[dict]:
        for ids, ys, texts in parts:
            rows = Grams(texts).rows(len(texts))
            yield {"doc_id": ids, "y": ys, "n": [len(x) for x, _ in rows], "x": [packed(*r) for r in rows]}

    written = materialize(map_texts(known, scan, "doc_id long, y int, n long, x binary", ("doc_id", "y", "text")).withColumn("row", F.monotonically_increasing_id()), "sample")
    # a doc_id that repeats in docs multiplies its rows, so the bound is applied again, to keys alone
    keys = written.select("doc_id", "y", "row", "n", F.xxhash64("x").alias("key")).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "key").limit(sample)
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "row"))  # over ``sample`` keys at most
    kept = keys.withColumn("upto", upto).where(F.col("upto") <= grams_bound).select("row")
    rows = written.join(F.broadcast(kept), "row")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y", "row"])
        w = train([unpacked(x) for x in pdf["x"]], pdf["y"].to_numpy())
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "w binary").first()
    discard(written)
    return np.frombuffer(found["w"], "<f4").astype(float) if found else train([], np.empty(0, int))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scan(parts: Iterator) -> Iterator[dict]:
        w = sent.value
        a, b = float(w[-2]), float(w[-1])
        for ids, texts in parts:
            m = Grams(texts).margins(w[:-3], len(texts)) + float(w[-3])
            yield {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))}

    return map_texts(docs, scan, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels that are not held out."""
    scored = score(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
