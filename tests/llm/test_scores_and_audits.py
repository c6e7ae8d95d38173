"""Toxicity, ranked search and divergence against brute-force versions on the awkward corpus."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from netpanel.llm import divergence, lexical, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- toxicity -------------------------------------------------------------------------------


def grams_by_hand(text):
    out = Counter()
    for word in set(TERM.findall((text or "").lower())):
        s = f" {word} "
        for k in toxicity.SIZES:
            out.update(s[i : i + k] for i in range(len(s) - k + 1))
    return out


def test_grams_are_those_of_distinct_words(texts):
    some = [t for _, t in texts][:40]
    rows = toxicity.Grams(some).rows(len(some))
    cell = {}
    for text, (cells, counts) in zip(some, rows, strict=True):
        want = grams_by_hand(text)
        assert counts.sum() == sum(want.values())
        for g in want:  # the cell of an n-gram does not depend on where it stands
            alone = toxicity.Grams([g.strip()])
            cell.setdefault(g, set(alone.cells.tolist()))
            assert cell[g] & set(cells.tolist())
    weights = np.random.default_rng(0).normal(size=toxicity.DIMENSIONS)
    sums = toxicity.Grams(some).margins(weights, len(some))
    assert np.allclose(sums, [float(weights[x] @ c) for x, c in rows])


def toxic_corpus(n=900):
    rng = np.random.default_rng(5)
    syllables = ["an", "er", "th", "is", "on", "the", "ing", "ou", "re", "sh", "ti", "ble", "für", "né", "мир"]
    make = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = [make() for _ in range(int(rng.choice([6, 60, 900], p=[0.4, 0.5, 0.1])))]
        if toxic:  # one inflected word, in a text of any length
            words[int(rng.integers(len(words)))] = str(rng.choice(["Grumpf", "zorkél"])) + make()
        docs.append((i, " ".join(words), "x", "s"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_is_learned_and_judged_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(d, lab).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out]
    caught = np.mean([r.predicted for r in out if truth[r.doc_id]])
    wrong = np.mean([r.predicted for r in out if not truth[r.doc_id]])
    assert caught > 0.9 and wrong < 0.01, (caught, wrong)
    again = toxicity.classify(d.repartition(7, "text"), lab).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = [(np.sort(rng.choice(40, 8, replace=False)), rng.normal(size=8)) for _ in range(120)]
    y = (np.array([v.sum() for _, v in x]) + rng.normal(size=120) > 0).astype(int)
    w = toxicity.descend(x, y, cost=0.1, epochs=400)

    def loss(w):
        m = np.array([float(w[i] @ v) for i, v in x]) + w[-1]
        return 0.5 * float(w @ w) + 0.1 * np.maximum(0, 1 - np.where(y > 0, 1, -1) * m).sum()

    best = loss(w)
    for _ in range(300):
        step = np.zeros(len(w))
        step[:40] = rng.normal(size=40) * 0.02
        step[-1] = rng.normal() * 0.02
        assert loss(w + step) >= best - 1e-6


def test_toxicity_cases(spark, docs, empty):
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, lab).collect()
    assert len(got) == docs.count() and all(r.score is not None for r in got)
    assert len({r.score for r in toxicity.classify(docs, lab).where("doc_id is null").collect()}) >= 1
    none = toxicity.classify(docs, lab.where("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    ones = toxicity.classify(docs, lab.where("toxic = 1")).collect()
    assert min(r.score for r in ones) > 0.99
    assert toxicity.classify(empty, lab).count() == 0
    repeated = docs.unionByName(docs).unionByName(docs)
    assert toxicity.classify(repeated, lab).count() == 3 * docs.count()


# --- ranked search --------------------------------------------------------------------------


def search_by_hand(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + (25 * bag.total() * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in TERM.findall((text or "").translate(UPPER)) if bag[t])
            if s > 0:
                found.append((-s, doc is None, doc))
        for rank, (s, _, doc) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


ITEMS = "item_id long, text string, lang string"


def items_of(texts):
    long = [t for _, t in texts if t and len(t.split()) > 20]
    out = [(i, " ".join(t.split()[3:40])) for i, t in enumerate(long[:12])]
    out += [(100, None), (101, ""), (102, "... !!! "), (103, "nothingthere"), (104, "a A a b"), (105, "ÀÉ ñandú 日本語"), (106, "word word one"), (106, "word word one"), (None, "12345 token"), (107, " ".join(t for _, t in texts if t)[:40000])]
    return out


@pytest.mark.parametrize(("k", "ranges", "block", "chunk"), [(20, 2048, 256, 1 << 20), (3, 7, 4, 90), (1, 1, 1, 1 << 20), (200, 16, 3, 400)])
def test_search(spark, docs, texts, k, ranges, block, chunk):
    items = items_of(texts)
    got = lexical.rank(docs, spark.createDataFrame([(*r, "en") for r in items], ITEMS), k, chunk, ranges, block).collect()
    assert Counter(map(tuple, got)) == search_by_hand(texts, items, k)


def test_search_of_many_ties(spark):
    rows = [(i, "the same words in every copy" if i % 3 else f"the words number {i}") for i in range(400)]
    items = [(1, "same words"), (2, "the"), (3, "the number 12 12")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = lexical.rank(d, spark.createDataFrame([(*r, "") for r in items], ITEMS)).collect()
    assert Counter(map(tuple, got)) == search_by_hand(rows, items, 20)


def test_search_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "one word", "en")], ITEMS)
    assert lexical.rank(docs, none).count() == 0
    assert lexical.rank(empty, some).count() == 0
    assert lexical.rank(docs, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_threshold_is_the_largest_that_is_safe():
    rng = np.random.default_rng(4)
    q = lexical.Queries([7, 9], [[0, 1, 1, 2], [3]])
    for _ in range(50):
        weights, tops = rng.integers(1, 50, 4), rng.integers(1, 1000, 4)
        bounds = np.array([int(rng.integers(1, 40_000)), 0])
        t = lexical.thresholds(q, weights, tops, bounds)
        high = weights[:3] * np.array([1, 2, 1]) * tops[:3]
        assert np.minimum(high, t[0] - 1).sum() < bounds[0] and t[1] == 1
        assert t[0] == bounds[0] + 1 or np.minimum(high, t[0]).sum() >= bounds[0]


# --- divergence -----------------------------------------------------------------------------


def audit_by_hand(rows, least, top):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = LETTERS.findall((text or "").translate(UPPER))
        groups[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(groups[lang, s]) for s in sources}
        q = shares(sum((groups[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "slices", "block", "rounds"), [(10, 1 << 16, 4, 8), (2, 7, 1, 1), (1, 50, 2, 2), (3, 1000, 3, 1)])
def test_divergence(docs, least, slices, block, rounds):
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    got = divergence.audit(docs, least=least, slice_terms=slices, block=block, rounds=rounds).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == audit_by_hand(rows, least, 10)


def test_divergence_of_groups_without_terms(spark, empty):
    rows = [("word " * 3, "xx", f"s{i % 5}") for i in range(30)] + [(None, "xx", "silent"), ("123", "yy", "a"), ("", "yy", "b"), ("only once", None, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = divergence.audit(d).collect()
    assert set(map(tuple, got)) == audit_by_hand(rows, 10, 10)
    assert {(r.lang, r.source, r.value) for r in got if r.lang == "yy"} == {("yy", "a", 0), ("yy", "b", 0)}
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("blocks", range(1, 12))
def test_every_two_blocks_meet_once(spark, blocks):
    members = "array<struct<g:int,total:long,counts:binary>>"
    r = spark.createDataFrame([("x", 0, b, 1, [(b, 1, b"")], blocks) for b in range(blocks)], f"lang string, slice int, block int, terms long, members {members}, blocks long")
    turns = blocks + blocks % 2 - 1
    seen = []
    for t in range(turns if blocks > 1 else 0):
        met = [(m.members[0].g, m.peers[0].g) for m in divergence.meetings(r, range(t, t + 1)).collect()]
        assert len({b for pair in met for b in pair}) == 2 * len(met)  # a block meets one other in a round
        seen += met
    assert sorted(seen) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 17, 10**12, 8 * 10**14, 3])
    total = int(counts.sum()) + 2 * len(counts)
    assert divergence.scaled(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
    assert divergence.unpack(divergence.pack(np.array([0, 5, 900]), np.array([1, 2, 10**14])))[1].tolist() == [1, 2, 10**14]
