"""How the vocabulary of each source of a language differs from its peers', by systolic rotation.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each language
keeps the terms in at least LEAST of its documents. A group (language, source) has p = 1 +
floor(10**9 * (count + 2) / (N + 2 V)) for each of the V kept terms, N its occurrences of them; a
language has the same of all its documents. The divergence of p and q is the sum of
floor((p - q)**2 / (p + q)).

The groups' counts are dealt out by (language, slice of its terms, block of its groups); a
cell's row holds the compressed sparse vectors of its block's groups over its slice, and
stays where it is. In round-robin tournament rounds the cells' vectors circulate: in each round
each block of a language meets one other block at most, and a meeting evaluates both
directions of all its pairs of groups. In round 0 a block meets itself and its language's
own vector, from which local heaps take each group's leading terms. Divergences are sums over
terms, so slices are added up afterwards, and no task holds more than two blocks over one slice.

Defined cases: null text, lang and source count as ''; a group without terms has p = 1 +
floor(2 * 10**9 / (2 V)) everywhere; a language that keeps no term has divergences of 0 and no
terms; a source alone in its language has no pairs; equal rows count each; doc_id and
other columns are not read; an empty table gives an empty result. Words are hashed
within a batch only, to 64 bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_LETTERS, Words, discard, distinct_at, materialize, ranges, split_batch

#: Documents that must hold a term; ranks of terms.
LEAST, TOP = 10, 10
#: Terms of a slice, groups of a block, tournament rounds of one job.
SLICE, BLOCK, ROUNDS = 1 << 13, 4, 8
SCALE = 1_000_000_000


def group_columns() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): pre-aggregated in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, 2):
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                names = sorted(set(pairs))
                index = {g: i for i, g in enumerate(names)}
                group = np.array([index[g] for g in pairs])
                w = Words(batch.column(2).to_pylist(), lower=True, gaps=NOT_LETTERS)
                if not len(w.starts):
                    continue
                h = w.hashes()
                doc = np.repeat(np.arange(len(pairs)), np.diff(w.first))
                order = np.lexsort((doc, h, group[doc]))
                g, h, d = group[doc][order], h[order], doc[order]
                new = distinct_at(h) | distinct_at(g)
                at = np.flatnonzero(new)
                df = np.add.reduceat((new | distinct_at(d)).astype(np.int64), at)
                first = order[at]
                lengths = w.ends[first] - w.starts[first]
                data = w.buf[ranges(w.starts[first], lengths)]
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                terms = pa.Array.from_buffers(pa.utf8(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                langs, sources = (pa.array([x[k] for x in names]).take(pa.array(g[at])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(np.diff(np.append(at, len(h)))), pa.array(df)], names=["lang", "source", "term", "n", "df"])

    found = docs.select(*group_columns(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), exactly, total being over count + 1."""
    rest, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    if total < 2**63 // SCALE:
        return 1 + SCALE * rest // total
    for _ in range(3):  # three digits at a time: no product leaves 64 bits up to 9 * 10**15 words
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pack(at: np.ndarray, count: np.ndarray) -> bytes:
    """A sparse vector: gaps between places, then counts, compressed."""
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), count]).astype("<i8").tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def dense(raw: bytes, total: int, terms: int) -> np.ndarray:
    """p of each term of the slice; total: N + 2 V of the group."""
    at, count = unpack(raw)
    out = np.zeros(terms, np.int64)
    out[at] = count
    return scaled(out, total)


CELL = "lang string, slice int, block int, terms long, members array<struct<g:int,total:long,counts:binary>>"


def cells(entries: DataFrame) -> DataFrame:
    """One row a (lang, slice, block): its groups g with their packed counts. entries: lang, slice,
    block, g, total, terms, at, n; a row with null ``at`` names a group only."""

    def build(table: pa.Table) -> pa.Table:
        g, total, at, n = (table.column(c).to_numpy() for c in ("g", "total", "at", "n"))
        known = ~np.isnan(at.astype(float))
        members = []
        for one in np.unique(g).tolist():
            mine = np.flatnonzero(known & (g == one))
            own = mine[np.argsort(at[mine])]
            members.append({"g": one, "total": int(total[g == one][0]), "counts": pack(at[own].astype(np.int64), n[own].astype(np.int64))})
        first = {c: [table.column(c)[0].as_py()] for c in ("lang", "slice", "block", "terms")}
        kinds = {"lang": pa.string(), "slice": pa.int32(), "block": pa.int32(), "terms": pa.int64(), "members": pa.list_(pa.struct([("g", pa.int32()), ("total", pa.int64()), ("counts", pa.binary())]))}
        return pa.table({c: pa.array(v, type=kinds[c]) for c, v in (first | {"members": [members]}).items()})

    return entries.groupBy("lang", "slice", "block").applyInArrow(build, CELL)


def opponent(block: Column, seats: Column, turn: Column) -> Column:
    """Whom a block meets in a turn (0 ... seats - 2) of a round-robin tournament of an even number
    of seats: the last seat stays, the others rotate."""
    others = seats - 1
    facing = F.pmod(turn - block, others)
    pivot = F.pmod(turn * (seats / 2).cast("int"), others)
    return F.when(block == others, pivot).when(facing == block, others).otherwise(facing).cast("int")


def meetings(residents: DataFrame, turns: range) -> DataFrame:
    """lang, slice, terms, members, peers: residents with the block that reaches them in each of the turns;
    each two blocks meet at the lesser one. An odd number of blocks leaves one of them idle in each turn."""
    seats = (F.col("blocks") + F.col("blocks") % 2).cast("int")
    turn = F.explode(F.sequence(F.lit(turns.start), F.lit(turns.stop - 1)))
    moving = residents.select("*", turn.alias("turn")).where(F.col("turn") < seats - 1).withColumn("meets", opponent(F.col("block"), seats, F.col("turn")))
    peers = moving.where("meets < block").select("lang", "slice", F.col("meets").alias("block"), F.col("members").alias("peers"))
    return residents.join(peers.hint("merge"), ["lang", "slice", "block"]).select("lang", "slice", "terms", "members", "peers")


def vectors(members: list[dict], terms: int) -> dict[int, np.ndarray]:
    return {m["g"]: dense(m["counts"], m["total"], terms) for m in members}


def compared(meets: DataFrame) -> DataFrame:
    """lang, g, h, value: both directions of each pair of a resident's group and a peer's; in a
    meeting with itself (null peers) of each two groups of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, terms = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                here = vectors(batch.column(2)[i].as_py(), terms)
                other = batch.column(3)[i].as_py()
                there = here if other is None else vectors(other, terms)
                out = []
                for g, p in here.items():
                    for h, q in there.items():
                        if other is not None or g < h:
                            value = int(divergence(p, q).sum())
                            out += [(g, h, value), (h, g, value)]
                if out:
                    g, h, v = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(g, pa.int32()), pa.array(h, pa.int32()), pa.array(v, pa.int64())], names=["lang", "g", "h", "value"])

    return meets.select("lang", "terms", "members", "peers").mapInArrow(run, "lang string, g int, h int, value long")


def leading(residents: DataFrame, whole: DataFrame, top: int) -> DataFrame:
    """lang, slice, g, at, value: of each group the terms of a slice, ``top`` at most, that it has above its
    language's share and whose part of the divergence is largest (ties: the lesser term first)."""
    met = residents.join(whole.select("lang", "slice", F.element_at("members", 1).alias("all")).hint("merge"), ["lang", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, part, terms, members, every = (batch.column(k)[i].as_py() for k in range(5))
                q = dense(every["counts"], every["total"], terms)
                rows = []
                for m in members:
                    at, count = unpack(m["counts"])
                    p = scaled(count, m["total"])
                    above = p > q[at]
                    f = divergence(p[above], q[at][above])
                    best = heapq.nsmallest(top, zip((-f).tolist(), at[above].tolist(), strict=True))
                    rows += [(m["g"], a, -v) for v, a in best]
                if rows:
                    g, a, v = zip(*rows, strict=True)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(g, pa.int32()), pa.array(a, pa.int32()), pa.array(v, pa.int64())], names=["lang", "slice", "g", "at", "value"])

    return met.select("lang", "slice", "terms", "members", "all").mapInArrow(run, "lang string, slice int, g int, at int, value long")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, slice_terms: int = SLICE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each group from each peer (part
    pair) and its ``top`` leading terms against its language (part term)."""
    counts = materialize(count_terms(docs), "counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= least).select("lang", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all_n"))
    pairs = docs.select(*group_columns()).distinct()
    by_lang = Window.partitionBy("lang")  # one row a source
    groups = pairs.withColumn("g", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("groups", F.count(F.lit(1)).over(by_lang))
    zero = F.lit(0).cast("long")
    langs = groups.select("lang", "groups").distinct().join(sizes, "lang", "left").select("lang", "groups", F.coalesce("v", zero).alias("v"), F.coalesce("all_n", zero).alias("all_n"))
    langs = materialize(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int")).withColumn("blocks", F.ceil(F.col("groups") / block).cast("int")), "langs")

    # terms get places in their slice, in the order of their bytes
    sliced = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    places = materialize(sliced.select("lang", "term", "n", "slice", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).alias("at")), "places")
    held = counts.select("lang", "source", "term", "n").join(places.select("lang", "term", "slice", "at").hint("merge"), ["lang", "term"])
    held = materialize(held.select("lang", "source", "slice", "at", "n"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    named = groups.drop("groups").join(totals, ["lang", "source"], "left").join(langs, "lang")
    named = materialize(named.select("lang", "source", "g", F.floor(F.col("g") / block).cast("int").alias("block"), (F.coalesce("own", zero) + 2 * F.col("v")).alias("total"), "slices"), "groups")

    inside = places.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("terms"))
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    none = F.lit(None).cast("int")
    present = named.select("lang", "block", "g", "total", each, none.alias("at"), zero.alias("n"))
    entries = held.join(named.select("lang", "source", "block", "g", "total"), ["lang", "source"]).select("lang", "block", "g", "total", "slice", "at", "n")
    own = present.unionByName(entries).join(inside, ["lang", "slice"], "left").withColumn("terms", F.coalesce("terms", zero))
    residents = materialize(cells(own).join(langs.select("lang", "blocks"), "lang"), "residents")
    every = places.join(langs.select("lang", (F.col("all_n") + 2 * F.col("v")).alias("total")), "lang").join(inside, ["lang", "slice"])
    whole = cells(every.select("lang", "slice", F.lit(-1).alias("block"), F.lit(-1).alias("g"), "total", "terms", "at", "n"))

    terms = leading(residents, whole, top).join(places.select("lang", "slice", "at", F.col("term").alias("item")), ["lang", "slice", "at"])
    terms = ranked(terms.join(named.select("lang", "g", "source"), ["lang", "g"]), "term").where(F.col("rank") <= top)

    alone = residents.withColumn("peers", F.lit(None).cast(dict(residents.dtypes)["members"]))
    most = langs.agg(F.max("blocks")).first()[0] or 0
    turns = most + most % 2 - 1
    met = [materialize(compared(alone), "round")]
    for start in range(0, turns if most > 1 else 0, rounds):
        met.append(materialize(compared(meetings(residents, range(start, min(start + rounds, turns)))), "round"))
    sums = reduce(DataFrame.unionByName, met).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    peer = named.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = ranked(sums.join(named.select("lang", "g", "source"), ["lang", "g"]).join(peer, ["lang", "h"]), "pair")
    out = materialize(pairs.unionByName(terms), "audit")
    discard(counts, kept, langs, places, held, named, residents, *met)
    return out
