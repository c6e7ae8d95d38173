"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct word 5-grams (one gram of all its words if it has
fewer), A-Z lower-cased. Under each of HASHES permutations both the least and the
greatest value are kept, so 2 * HASHES components cost HASHES evaluations; each is an
unbiased estimate of the resemblance. Bands of ROWS components are bucket keys.

Documents with equal sets form a class, which goes on as its smallest doc_id alone. In
each bucket of several classes, a few leaders (least under a hash that depends on the
band) are compared with the members on their full sets, and links are joined into
components. A bucket whose members are then in one component is settled, however large
it is. The members of the others are compared by their prefixes: with shingles in an order
from rare to frequent, two similar sets share one of their first few, early enough in both.
For each such shingle the set that has it earliest is a leader once more (of copies of one
text it is the original, as it has no rare shingles of its own). What is then still in
different components makes pairs, and these are confirmed on full sets. A family of texts
from one template, too different to be linked, has only own shingles at the front, so it
makes no pairs at all.

At the threshold t a pair shares no band with probability (1 - t ** ROWS) ** BANDS: 4e-7 at
0.85, 5e-5 at 0.8. All that follows is exact.

Defined cases: a null text, and one without words, has no shingles and is linked with
nothing; equal texts are linked; rows that repeat a doc_id count as one document; a null
doc_id is linked with equal sets only, is not kept if such a row has a doc_id, and has
its class's component or null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, map_texts, materialize, mix64, rolling, split_batch
from .graph import components

SHINGLE = 5
HASHES, ROWS = 64, 5
BANDS = 2 * HASHES // ROWS
#: Least intersection for each 100 of the union: of op5's contract, and of other uses.
CONTRACT, THRESHOLD = 85, 80
#: Different orders by which the leaders of a bucket are picked.
LEADERS = 3
#: Partners of a document that are compared with it in one task.
PARTNERS = 64
#: Cells in which the frequency of shingles is counted.
CELLS = 1 << 18

_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    grams = rolling(h, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(rolling(h[a:b], b - a, 0xA0761D6478BD642F + 2 * (b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x 2 * HASHES) uint32: least and greatest value under each permutation; rows of empty sets are 0."""
    out = np.zeros((len(sets), 2 * HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for k in range(HASHES):
        v = ((x * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        out[full, 2 * k] = np.minimum.reduceat(v, first)
        out[full, 2 * k + 1] = np.maximum.reduceat(v, first)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the set), signature of every row."""

    def scan(parts: Iterator) -> Iterator[dict]:
        for ids, texts in parts:
            sets = shingle_sets(texts)
            sig = signatures(sets)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield {"doc_id": ids, "n_shingles": [len(s) for s in sets], "set_key": keys, "signature": [r.tobytes() for r in sig]}

    return map_texts(docs, scan, "doc_id long, n_shingles long, set_key binary, signature binary")


def bands(reps: DataFrame) -> DataFrame:
    """band, key, rep, size: BANDS rows for each class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(n, -1)[:, : BANDS * ROWS].astype(np.uint64)
                key = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):  # a band mixes minima and maxima of several permutations
                    key = mix64(key ^ band_values(sig)[:, r]) + np.arange(BANDS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(key.astype(np.int64).ravel()),
                        pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(np.repeat(part.column(1).to_numpy(), BANDS)),
                    ],
                    names=["band", "key", "rep", "size"],
                )

    return reps.select("rep", "n_shingles", "signature").mapInArrow(cut, "band int, key long, rep long, size long")


def confirm(pairs: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The texts of a's partners go to groups
    of about PARTNERS, each with a's text, so no document is hot."""
    many = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PARTNERS), "many")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / PARTNERS))
    pairs = pairs.join(many, "a", "left").select("a", "b", part.alias("part"))
    own = pairs.select("a", "part").distinct().select(F.col("a").alias("doc_id"), "a", "part")
    asked = pairs.select(F.col("b").alias("doc_id"), "a", "part").unionByName(own)
    sent = asked.join(texts.hint("merge"), "doc_id").select("doc_id", "a", "part", "text")

    def compare(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        centre: list[np.ndarray] = []
        others: list[tuple[int, np.ndarray]] = []
        for batch in table.combine_chunks().to_batches():
            for part in split_batch(batch, 3):
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(3).to_pylist()), strict=True):
                    if doc == a:
                        centre.append(s)
                    else:
                        others.append((doc, s))
        found = [doc for doc, s in others if any(linked(s, c, t) for c in centre)]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return sent.groupBy("a", "part").applyInArrow(compare, "a long, b long").dropDuplicates(["a", "b"])


def linked(x: np.ndarray, y: np.ndarray, t: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < t * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= t * (len(x) + len(y) - both)


def band_values(sig: np.ndarray) -> np.ndarray:
    """(rows x ROWS x BANDS): the components of each band."""
    return sig[:, : BANDS * ROWS].reshape(len(sig), ROWS, BANDS)


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, root, open: the members of buckets with several components, and these buckets."""
    held = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    held = materialize(held.select("rep", "root", F.xxhash64("band", "key").alias("bucket")), "held")
    # where a bucket has two members, its leader has met the other
    open_ = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("bucket")
    open_ = materialize(open_, "open")
    members = materialize(held.join(open_, "bucket").groupBy("rep", "root").agg(F.collect_list("bucket").alias("open")), "members")  # BANDS at most
    discard(held, open_)
    return members


def frequencies(texts: DataFrame) -> np.ndarray:
    """For each cell the rounded binary logarithm of its shingles' number, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in split_batch(batch, 0):
                found = np.concatenate([np.empty(0, np.uint64), *shingle_sets(part.column(0).to_pylist())])
                total += np.bincount((found % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.uint8)
    out[found["cell"]] = np.round(np.log2(found["n"].to_numpy() + 1))
    return out


def prefixes(texts: DataFrame, level: np.ndarray, t: int) -> DataFrame:
    """g, rep, root, size, at, short: the first shingles of each text (rep, root, text), rare ones
    first. Of sets a and b, a not larger, that are similar enough, one is among a's ``short``
    ones and among b's."""
    sent = texts.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            for part in split_batch(batch, 2):
                sets = shingle_sets(part.column(2).to_pylist())
                size = np.array([len(s) for s in sets], np.int64)
                keep, short = size - -(-t * size // 100) + 1, size - -(-2 * t * size // (100 + t)) + 1
                first = [s[np.lexsort((s, level[(s % np.uint64(CELLS)).astype(np.int64)]))[:k]] for s, k in zip(sets, keep.tolist(), strict=True)]
                at = np.concatenate([np.arange(len(f)) for f in first])
                n = [len(f) for f in first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(first).astype(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(part.column(1).to_numpy(), n)),
                        pa.array(np.repeat(size, n)), pa.array(at), pa.array(at < np.repeat(short, n)),
                    ],
                    names=["g", "rep", "root", "size", "at", "short"],
                )

    return texts.select("rep", "root", "text").mapInArrow(run, "g long, rep long, root long, size long, at long, short boolean")


def front(members: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """prefixes() of the members."""
    own = texts.withColumnRenamed("doc_id", "rep").join(members.select("rep", "root").hint("merge"), "rep").select("rep", "root", "text")
    return materialize(prefixes(own, frequencies(own), t), "front")


def undecided(tokens: DataFrame) -> DataFrame:
    """The tokens of shingles that sets of several components have."""
    several = tokens.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    several = materialize(several, "several")
    out = materialize(tokens.join(several, "g"), "undecided")
    discard(several)
    return out


def early(a: str, b: str, t: int) -> Column:
    """Whether sets of different components may be linked, as they share no shingle before these places."""
    size_a, size_b, at_a, at_b = (F.col(f"{s}_{c}") for c in ("size", "at") for s in (a, b))
    most = F.least(size_a - at_a, size_b - at_b)
    close = 100 * F.least(size_a, size_b) >= t * F.greatest(size_a, size_b)
    return (F.col(f"{a}_root") != F.col(f"{b}_root")) & close & ((100 + t) * most >= t * (size_a + size_b))


def sided(tokens: DataFrame, side: str) -> DataFrame:
    return tokens.select("g", *(F.col(c).alias(f"{side}_{c}") for c in ("rep", "root", "size", "at", "short")))


def front_stars(tokens: DataFrame, t: int) -> DataFrame:
    """a, b: for each set the earliest leader among its shingles' that it may be linked with."""
    leaders = tokens.groupBy("g").agg(F.min(F.struct("at", "rep", "root", "size", "short")).alias("l")).select("g", "l.*")
    leaders = materialize(leaders, "front_leaders")
    met = sided(leaders, "a").join(sided(tokens, "b"), "g").where(early("a", "b", t))
    best = met.groupBy("b_rep").agg(F.min(F.struct("a_at", "a_rep")).alias("l"))
    out = materialize(best.select(F.col("l.a_rep").alias("a"), F.col("b_rep").alias("b")), "front_stars")
    discard(leaders)
    return out


def close_pairs(tokens: DataFrame, members: DataFrame, t: int) -> DataFrame:
    """a, b: the members of common unsettled buckets, of different components, that may be linked."""
    lesser = (F.struct("a_size", "a_rep") < F.struct("b_size", "b_rep")) & F.col("a_short")
    met = sided(tokens, "a").join(sided(tokens, "b"), "g").where(lesser & early("a", "b", t))
    pairs = materialize(met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct(), "pairs")
    both = pairs
    for side in "ab":
        both = both.join(members.select(F.col("rep").alias(side), F.col("open").alias(f"open_{side}")), side)
    out = materialize(both.where(F.arrays_overlap("open_a", "open_b")).select("a", "b"), "close")
    discard(pairs)
    return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of labels (node, root) and links (a, b) together."""
    if links.isEmpty():
        return labels
    return materialize(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "labels")


def near_dedup(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; t: least intersection for each 100 of the union."""
    rows = materialize(sign(docs), "signed")
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.where("rep is not null"), "classes")
    firsts = classes.select("set_key", F.col("rep").alias("doc_id"))
    reps = rows.join(firsts.hint("merge"), ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature")
    cut = materialize(bands(reps), "bands")
    # tables of bucket keys are written before they are joined: as plain exchanges, adaptive execution can split a hot key
    shared = materialize(cut.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key"), "bucket_keys")
    buckets = materialize(cut.join(shared, ["band", "key"]), "buckets")
    order = F.xxhash64("rep", F.col("band") % LEADERS)
    leaders = buckets.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), "rep", "size")).alias("l")).select("band", "key", F.col("l.rep").alias("lead"), F.col("l.size").alias("lead_size"))
    leaders = materialize(leaders, "leaders")
    sizes = (F.col("rep") != F.col("lead")) & (100 * F.least("size", "lead_size") >= t * F.greatest("size", "lead_size"))
    stars = buckets.join(leaders, ["band", "key"]).where(sizes).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(stars, "stars")
    named = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(docs.select("doc_id", "text").join(named.hint("merge"), "doc_id"), "texts")
    links = materialize(confirm(stars, texts, t), "links")
    labels = materialize(components(links), "labels")
    members = unsettled(buckets, labels)
    discard(cut, shared, leaders, buckets, stars)
    tokens = undecided(front(members, texts, t))
    stars2 = front_stars(tokens, t)
    links2 = materialize(confirm(stars2, texts, t), "links2")
    labels = joined(labels, links2)
    now = labels.select(F.col("node").alias("rep"), F.col("root").alias("now"))
    tokens2 = undecided(tokens.join(now, "rep", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))
    close = close_pairs(tokens2, members, t)
    links3 = materialize(confirm(close, texts, t), "links3")
    labels = joined(labels, links3)
    discard(links, texts, members, tokens, stars2, links2, tokens2, close, links3)
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    found = materialize(found.where("n > 1 or root <> rep").select("set_key", "root"), "found")
    discard(classes)
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_near_copies(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that near_dedup() keeps; rows without a doc_id stay."""
    gone = near_dedup(docs, t).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
