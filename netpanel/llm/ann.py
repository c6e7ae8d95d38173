"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred on the mean, rotated by a fixed random orthogonal matrix, and kept as
sign bits with three numbers: the length of the centred vector, its inner product with
its own code, and its inner product with the centre. A query is rotated too and cut into
bit planes, so an estimate is a few population counts; an error bound that holds with
high probability turns estimates into intervals. In a block of queries against a block of
candidates the best estimates are scored exactly first; then only the candidates whose
upper limit reaches the k-th best of those scores are reranked by the exact inner product,
and the best k of each block meet in a window.

The query set is stated (rows whose id is divisible by 20) and goes against all rows in
blocks of bounded size. A candidate travels once, with its code and its vector in the
table's own precision, as long as the queries fill one block; only queries, a twentieth of
all rows, are copied to every block of candidates. Vectors are not fetched by survivor:
each query scores at least FIRST * K of them in each block, which is more bytes than the
block itself has. Defined cases: vectors that are null, zero, or hold null or
non-finite components take no part, nor do those of another dimension than the most
frequent (the larger of two equally frequent); rows with a null id take no part; rows
of a repeated id are separate candidates, and separate queries (each with its own ranks)
where their vectors differ; a query never meets its own id; ties go to the smaller id;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, QUERY_STEP = 20, 20
#: Rows of a block of candidates, and of queries: what one task's group holds at most.
CANDIDATES, QUERIES = 65_536, 16_384
#: Smaller tables are dealt over so many blocks of candidates, if each has SMALL rows at least.
PARTS, SMALL = 64, 4096
#: For each neighbour asked for, so many of the best estimates are scored first.
FIRST = 32
#: Width of the error bound, in standard deviations of the estimate.
EPSILON = 4.0
#: Bits of a rotated query's components.
PLANES = 4
SEED = 20


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code(x: np.ndarray, centre: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits (rows x words, uint64) and the numbers (length, code product, centre product)."""
    own = x - centre
    turned = own @ rotate.T
    length = np.linalg.norm(own, axis=1)
    sign = turned > 0
    dim = x.shape[1]
    words = -(-dim // 64)
    padded = np.zeros((len(x), words * 64), np.uint8)
    padded[:, :dim] = sign
    bits = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    safe = np.maximum(length, 1e-300)
    product = np.where(length > 0, np.abs(turned).sum(axis=1) / math.sqrt(dim) / safe, 1.0)
    return bits, np.stack([length, product, x @ centre], axis=1)


class Searcher:
    """One block of candidates, searched query by query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, numbers: np.ndarray, centre: np.ndarray, rotate: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(x[order].T)
        self.words = [np.ascontiguousarray(w) for w in bits[order].T]
        length, product, self.base = numbers[order].T
        self.ones = sum(np.bitwise_count(w).astype(np.float64) for w in self.words)
        self.rotate, self.dim = rotate, x.shape[1]
        self.scale = length / product
        spread = np.sqrt(np.maximum(1 - product**2, 0)) / math.sqrt(max(self.dim - 1, 1))
        self.error = EPSILON * spread * self.scale

    def estimates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate of <x, q> for each candidate, and how far it may be off."""
        turned = self.rotate @ q
        low = float(turned.min())
        step = (float(turned.max()) - low) / ((1 << PLANES) - 1) or 1.0
        levels = np.round((turned - low) / step).astype(np.int64)
        dot = np.zeros(len(self.ids), np.int32)
        for p in range(PLANES):
            plane = np.zeros(len(self.words) * 64, np.uint8)
            plane[: self.dim] = (levels >> p) & 1
            for mask, w in zip(np.packbits(plane, bitorder="little").view("<u8"), self.words, strict=True):
                dot += np.bitwise_count(w & mask).astype(np.int32) << p
        # the set bits' share of the quantised query, twice, less all of it: signs from bits
        root = math.sqrt(self.dim)
        with_code = self.ones * (2 * low / root) + dot * (2 * step / root) - (low * self.dim + step * float(levels.sum())) / root
        off = self.error * float(np.linalg.norm(q)) + self.scale * (step * root / 2)
        return self.base + self.scale * with_code, off

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        estimate, off = self.estimates(q)
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])  # rows are in id order
        estimate[a:b] = -np.inf
        n = len(self.ids)
        if n - (b - a) > k:
            m = min(n - (b - a), FIRST * k)
            found = self.exact(np.argpartition(estimate, n - m)[n - m :], q)
            floor = np.partition(found, m - k)[m - k]
            # what is lost in the last bits of the two sums stays far below this
            at = np.flatnonzero(estimate + off >= floor - 1e-9 * (1 + abs(floor)))
        else:
            at = np.concatenate([np.arange(a), np.arange(b, n)])
        score = self.exact(at, q)
        if len(at) > 4 * k:
            top = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])  # with all ties
            at, score = at[top], score[top]
        best = np.argsort(-score, kind="stable")[:k]  # ties stay in id order
        return list(zip(self.ids[at[best]].tolist(), score[best].tolist(), strict=True))

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return inner(self.columns, at, q)


def inner(columns: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision of the chosen vectors (columns: one row a component),
    summed component by component in order, so that equal vectors have equal products."""
    out = np.zeros(len(at))
    for j in range(len(q)):
        out += columns[j].take(at) * float(q[j])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("v")
    good = (
        v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
        & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    )
    shaped = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(good)
    dims = shaped.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return shaped.where(F.size("v") == (dims[0]["d"] if dims else 0))


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = usable(vectors)
    sums = rows.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("c")).orderBy("i").collect()
    centre = np.array([r["c"] for r in sums], float)  # as many numbers as a vector has
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % step == 0)).first()
    parts = max(1, math.ceil(n / CANDIDATES), min(PARTS, n // SMALL))
    blocks = max(1, math.ceil(n_queries / QUERIES))
    dim = len(centre)
    words = -(-dim // 64)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # the table's own precision

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate = rotation(dim)
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            bits, numbers = code(x, centre, rotate)
            codes = [np.concatenate([bits[i].view(np.uint8), numbers[i].view(np.uint8)]).tobytes() for i in range(len(x))]
            raw = [v.tobytes() for v in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "code", "raw"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, kind).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    candidates = rows.mapInArrow(encode, "vec_id long, code binary, raw binary").withColumn("part", part).withColumn("block", every_block)
    asked = rows.where(F.col("vec_id") % step == 0).mapInArrow(plain, "vec_id long, raw binary").distinct().withColumn("query", F.xxhash64("raw"))
    queries = asked.withColumn("block", block).withColumn("part", every_part)

    def unpack(t: pa.Table, name: str, dtype: str) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in t.column(name)), dtype).reshape(t.num_rows, -1)

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if mine.num_rows and asked.num_rows:
            codes = unpack(mine, "code", "u1")
            bits, numbers = (np.ascontiguousarray(c).view(d) for c, d in ((codes[:, : 8 * words], "<u8"), (codes[:, 8 * words :], "<f8")))
            s = Searcher(mine.column("vec_id").to_numpy(), unpack(mine, "raw", kind).astype(float), bits, numbers, centre, rotation(dim))
            for query_id, query, q in zip(asked.column("vec_id").to_pylist(), asked.column("query").to_pylist(), unpack(asked, "raw", kind).astype(float), strict=True):
                for vec_id, score in s.search(query_id, q, k):
                    for key, v in zip(out, (query_id, query, vec_id, score), strict=True):
                        out[key].append(v)
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in out.items()})

    found = candidates.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(search, "query_id long, query long, vec_id long, score double")
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
