"""Languages of a document as a mixture, by expectation-maximisation.

Learning counts the character trigrams of all words, by language, over the whole
training set (each task adds up its own texts first; trigrams are hashed into a fixed
number of cells, so the model has languages x CELLS numbers). For a document, each
distinct word has a likelihood under each language; EM estimates the proportions of the
languages, and the language set is the prefix of the languages by proportion whose
likelihood less a penalty for each further language is highest.

Defined cases: a null text, and one without a letter, is `und` with score 0, as is every
text if nothing could be learned; a null lang is not learned from; repeated rows count
as often as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix64, split_batch

CELLS = 1 << 16
SMOOTHING = 0.25
ITERATIONS = 12
#: Log-likelihood that a further language must gain for each log of the document's words.
PENALTY = 2.0
#: Distinct words whose likelihoods a worker remembers, and words counted before cells are added up.
CACHE_WORDS = 200_000
#: Longest word that is looked at in one piece; a longer one is cut.
WORD_LENGTH = 64



def _ranges(major: str) -> str:
    """The characters below U+10000 of a general category, as ranges of a character class."""
    spans: list[list[int]] = []
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == major:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


_letter, _mark = _ranges("L"), _ranges("M")
_plain_words = re.compile(f"[{_letter}][{_letter}{_mark}]{{0,{WORD_LENGTH - 1}}}").findall
_any_words = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{WORD_LENGTH - 1}}}").findall


def words(text: str) -> list[str]:
    """Runs of letters (and their marks; not digits, and not what only looks like a letter), lower-cased."""
    text = text.lower()
    beyond = len(text.encode("utf-16-le")) > 2 * len(text)  # characters that the quick pattern does not know
    return (_any_words if beyond else _plain_words)(text)



def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words, a space before and after each, one word after the
    other, and where each word's begin: a word of n letters has n."""
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    code = mix64(((a[:-2] << np.uint64(21)) + a[1:-1] << np.uint64(21)) + a[2:]) % np.uint64(CELLS)
    sizes = np.array([len(w) for w in words])
    return code[a[1:-1] != 32].astype(np.int64), np.cumsum(sizes) - sizes


def count(docs: DataFrame) -> DataFrame:
    """lang, cell, n over all rows of docs with a language and a text."""

    def run(parts: Iterator) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def fold() -> None:
            for lang, words in seen.items():
                total = totals.setdefault(lang, np.zeros(CELLS, np.int64))
                if words:
                    at, _ = trigrams(list(words))
                    n = np.repeat(list(words.values()), [len(w) for w in words])
                    total += np.bincount(at, weights=n, minlength=CELLS).astype(np.int64)
            seen.clear()

        for langs, texts in parts:
            for lang, text in zip(langs, texts, strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > CACHE_WORDS:
                fold()
        fold()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield {"lang": [lang] * len(at), "cell": at, "n": total[at]}

    usable = docs.where("lang is not null and text is not null")
    found = map_texts(usable, run, "lang string, cell int, n long", ("lang", "text"))
    return found.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of each cell under each language."""

    def __init__(self, langs: list[str], logp: np.ndarray) -> None:
        self.langs, self.logp = langs, logp


def fit(docs: DataFrame) -> Model:
    """The counts of all rows; what reaches the driver is languages x CELLS numbers at most."""
    c = count(docs).toPandas()
    langs = sorted(c["lang"].unique())
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32))
    n = np.zeros((CELLS, len(langs)))
    n[c["cell"].to_numpy(), np.searchsorted(np.array(langs, object), c["lang"].to_numpy())] = c["n"]
    n += SMOOTHING
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32))


class Mixture:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, len(model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Log-likelihoods of words that are new."""
        at, first = trigrams(words)
        k, need = len(self.index), len(self.index) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[:k], np.empty((need, self.rows.shape[1]), np.float32)])
        self.rows[k:need] = np.add.reduceat(self.model.logp[at], first, axis=0)
        self.index.update(zip(words, range(k, need), strict=True))

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float], bool]]:
        """(language, score, language set, its proportions, noise) of each text. Noise: evenly
        likely trigrams explain the words better than the chosen set, by a language's penalty."""
        if len(self.index) > CACHE_WORDS:
            self.index.clear()
            self.rows = self.rows[:1024]
        found = [Counter(words(t)) if t and self.model.langs else Counter() for t in texts]
        new = set().union(*found).difference(self.index)
        if new:
            self._learn(list(new))
        index = self.index
        at = [index[w] for f in found for w in f]
        n = [k for f in found for k in f.values()]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        out: list = [("und", 0.0, [], [], False)] * len(texts)
        if not at:
            return out
        doc, first = np.unique(owner, return_index=True)
        times = np.array(n, np.float32)
        log = self.rows[np.array(at)]
        top = log.max(axis=1, keepdims=True)
        like = np.exp(log - top)
        size = np.diff([*first, len(at)])
        total = np.add.reduceat(times, first)
        pi = np.full((len(doc), like.shape[1]), 1 / like.shape[1], np.float32)
        for _ in range(ITERATIONS):
            joint = like * np.repeat(pi, size, axis=0)
            joint *= (times / joint.sum(axis=1))[:, None]
            pi = np.add.reduceat(joint, first, axis=0) / total[:, None]
        alone = np.add.reduceat((log - top) * times[:, None], first, axis=0)
        order = np.argsort(-pi, axis=1, kind="stable")
        best_k, best = np.ones(len(doc), int), alone.max(axis=1)
        for k in range(2, like.shape[1] + 1):
            part = np.zeros_like(pi)
            np.put_along_axis(part, order[:, :k], np.take_along_axis(pi, order[:, :k], 1), 1)
            part /= part.sum(axis=1, keepdims=True)
            mixed = (like * np.repeat(part, size, axis=0)).sum(axis=1)
            got = np.add.reduceat(np.log(np.maximum(mixed, 1e-30)) * times, first) - PENALTY * (k - 1) * np.log(total + 1)
            better = got > best
            best_k[better], best[better] = k, got[better]
        letters = np.array([len(w) for f in found for w in f], np.float32)
        even = -np.log(CELLS) * np.add.reduceat(letters * times, first)
        noise = even - best - np.add.reduceat(top[:, 0] * times, first) > PENALTY * np.log(total + 1)
        for i, d in enumerate(doc.tolist()):
            chosen = [int(alone[i].argmax())] if best_k[i] == 1 else order[i, : best_k[i]].tolist()
            share = pi[i, chosen] / max(float(pi[i, chosen].sum()), 1e-9)
            out[d] = (self.model.langs[chosen[0]], float(min(1.0, max(0.0, pi[i, chosen[0]]))), [self.model.langs[c] for c in chosen], share.astype(float).tolist(), bool(noise[i]))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, langs, shares of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator) -> Iterator[dict]:
        mixture = Mixture(sent.value)
        for ids, texts in parts:
            found = mixture.infer(texts)
            yield {"doc_id": ids} | {k: [f[i] for f in found] for i, k in enumerate(("lang_pred", "score", "langs", "shares"))}

    return map_texts(docs, run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """predict() by a model of the rows of docs for which ``learn`` holds (default: not held out)."""
    return predict(docs, fit(docs.where(~held_out() if learn is None else learn)))


def known_only(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """The rows of docs, all columns, in a known language: their text has a letter, and the set of
    languages that the mixture chose explains it better than noise (infer()). Where no language
    could be learned, texts that have a letter stay."""
    model = fit(docs.where(~held_out() if learn is None else learn))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        mixture = Mixture(model)
        for batch in batches:
            for part in split_batch(batch, text_at):
                texts = part.column(text_at).to_pylist()
                if model.langs:
                    known = [f[0] != "und" and not f[4] for f in mixture.infer(texts)]
                else:
                    known = [bool(t and words(t)) for t in texts]
                yield part.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
