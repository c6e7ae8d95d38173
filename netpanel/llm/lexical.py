"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

Every document and query is a bag of terms (runs of ASCII letters and digits and of all
characters beyond ASCII, A-Z lower-cased). A term of weight w that occurs tf times in a
document adds, for each time the query repeats it, w * ((10**9 * tf) div (1000 * tf + 12 * m)) to
the document's score, with m = 75 + (25 * n * N) div L by the document's n terms.

A document's postings lie in lists, one for each term and range of documents (a hash of
the row), entries by falling value; so a term that every document has is spread over all
ranges. Three phases answer all queries at once:

1. Each list sends its head, the K largest values. The sums of what has arrived pick K documents
   for each query; their exact scores' least is a lower bound of the query's K-th best score.
2. One threshold for all lists of a query is the largest for which a document that is below it
   everywhere stays below that bound. Each list sends its entries from the threshold on, once for
   a block of queries. The K-th best sum over all ranges raises the bound, and upper bounds, with the
   threshold where nothing arrived, leave candidates.
3. The candidates' exact scores are looked up in their documents' rows.

Sums happen where a block's queries meet one range of documents, so no entry is copied for
each query. Queries are taken in chunks of about CHUNK_TERMS terms, each with all three phases; a
chunk's terms, weights and thresholds are what the driver and every task hold.

Defined cases: a null text has no terms and is not counted; a document or query without
terms has no results; equal rows, and rows that share a doc_id or item_id, are ranked each for
itself; equal scores go by ascending doc_id, null last, then by row; only scores above 0 count;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_ALPHANUMERIC, Words, discard, distinct_at, map_texts, materialize, ranges

#: Results of a query; documents of a range; queries of a block; terms, with repeats, of a chunk of queries.
K, RANGE_DOCS, BLOCK, CHUNK_TERMS = 20, 2048, 256, 1 << 20


def terms_of(texts: list[str | None]) -> list[list[str]]:
    w = Words(texts, lower=True, gaps=NOT_ALPHANUMERIC)
    raw, starts, ends = w.buf.tobytes(), w.starts.tolist(), w.ends.tolist()
    first = w.first.tolist()
    return [[raw[starts[i] : ends[i]].decode() for i in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]


class Vocabulary:
    """The sorted terms of a chunk of queries, found again in documents by their hash."""

    def __init__(self, terms: list[str]) -> None:
        self.raw = [t.encode() for t in terms]
        h = Words.of_bytes(self.raw).hashes() if terms else np.empty(0, np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]

    def find(self, w: Words) -> np.ndarray:
        """Index of each word's term, or -1."""
        out = np.full(len(w.starts), -1, np.int64)
        if not len(self.hashes) or not len(out):
            return out
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        out[hit] = self.order[at[hit]]
        by_term = hit[np.argsort(out[hit], kind="stable")]
        for i in by_term[distinct_at(out[by_term])].tolist():  # of each term one word of the batch is compared
            if w.buf[w.starts[i] : w.ends[i]].tobytes() != self.raw[int(out[i])]:
                raise ValueError("two terms share one hash")
        return out


def binaries(parts: np.ndarray, first: np.ndarray) -> pa.Array:
    """parts[first[i] : first[i + 1]] as the bytes of row i."""
    width = parts.itemsize
    if len(parts) * width >= 1 << 31:
        raise ValueError("more than 2 GB of postings in a batch")
    offsets = (first * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def numbers(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes as one array of numbers, and each row's count of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values, counts = [], []
    for c in chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            data = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if c.buffers()[2] is not None else np.empty(0, np.uint8)
            values.append(np.frombuffer(data.tobytes(), kind))
            counts.append(np.diff(offsets) // np.dtype(kind).itemsize)
    return (np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, kind), np.empty(0, np.int64))


class Queries:
    """A chunk's queries: the terms (indices) of each and how often it repeats each."""

    def __init__(self, ids: list[int], bags: list[list[int]], block: int = BLOCK) -> None:
        self.size, self.ids = block, np.array(ids, np.int64)
        self.at = {q: i for i, q in enumerate(ids)}
        pairs = [np.unique(np.array(b, np.int64), return_counts=True) for b in bags]
        self.first = np.cumsum([0, *(len(t) for t, _ in pairs)])
        self.terms = np.concatenate([t for t, _ in pairs]) if pairs else np.empty(0, np.int64)
        self.repeats = np.concatenate([c for _, c in pairs]) if pairs else np.empty(0, np.int64)

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    def blocks(self) -> int:
        return -(-len(self.ids) // self.size)

    def block(self, b: int) -> range:
        return range(b * self.size, min((b + 1) * self.size, len(self.ids)))


def thresholds(q: Queries, weights: np.ndarray, tops: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each query the largest t for which documents with every value below t stay below its
    bound; 1, which lets through all that counts, where there is no bound."""
    high = weights[q.terms] * q.repeats * tops[q.terms]
    out = np.ones(len(q.ids), np.int64)
    for i in np.flatnonzero(bounds > 0).tolist():
        h, low, up = high[q.of(i)], 1, int(bounds[i]) + 1
        while low < up:
            mid = (low + up + 1) // 2
            if int(np.minimum(h, mid - 1).sum()) < bounds[i]:
                low = mid
            else:
                up = mid - 1
        out[i] = low
    return out


def least_values(q: Queries, weights: np.ndarray, limits: np.ndarray, size: int) -> np.ndarray:
    """For each block (row) and term the least value that one of its queries asks for; -1: none does."""
    out = np.full((q.blocks(), size), np.iinfo(np.int64).max)
    each = np.repeat(np.arange(len(q.ids)), np.diff(q.first))
    factor = weights[q.terms] * q.repeats
    need = np.where(factor > 0, -(-limits[each] // np.maximum(factor, 1)), np.iinfo(np.int64).max)
    np.minimum.at(out, (each // q.size, q.terms), need)
    return np.where(out == np.iinfo(np.int64).max, -1, out)


class Meeting:
    """What the lists of one range of documents have sent to one block of queries."""

    def __init__(self, table: pa.Table) -> None:
        term, (self.rows, held), (self.values, _) = table.column("term").to_numpy(), numbers(table.column("rows"), "<i8"), numbers(table.column("vals"), "<i8")
        first = np.cumsum(held) - held
        self.lists = {int(t): slice(int(a), int(a + n)) for t, a, n in zip(term, first, held, strict=True)}
        self.docs, self.local = np.unique(self.rows, return_inverse=True)

    def sums(self, q: Queries, i: int, weights: np.ndarray, limit: int, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the values from the limit on, upper bound of the score) of each document for query i."""
        got, bound = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), np.int64)
        for t, r in zip(q.terms[q.of(i)].tolist(), q.repeats[q.of(i)].tolist(), strict=True):
            factor = int(weights[t]) * r
            unseen = min(factor * int(tops[t]), limit - 1) if tops is not None else 0
            bound += unseen
            s = self.lists.get(t)
            if s is not None and factor:
                v = self.values[s] * factor
                n = len(v) - int(np.searchsorted(v[::-1], limit)) if limit > 1 else len(v)
                at = self.local[s][:n]
                got[at] += v[:n]
                bound[at] += v[:n] - unseen
        return got, bound


def scan(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, n, terms, tfs: of each document its number of terms and, packed, which of the
    vocabulary it holds (rising) and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator) -> Iterator[dict]:
        for ids, texts in parts:
            w = Words(texts, lower=True, gaps=NOT_ALPHANUMERIC)
            found = sent.value.find(w)
            doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
            size = max(len(sent.value.raw), 1)
            key = np.sort(doc[found >= 0] * size + found[found >= 0])
            at = np.flatnonzero(distinct_at(key))
            tf, first = np.diff(np.append(at, len(key))), np.searchsorted(key[at], np.arange(len(texts) + 1) * size)
            yield {"doc_id": ids, "n": np.diff(w.first), "terms": binaries((key[at] % size).astype("<i4"), first).to_pylist(), "tfs": binaries(tf.astype("<i4"), first).to_pylist()}

    return map_texts(docs, run, "doc_id long, n long, terms binary, tfs binary").withColumn("row", F.monotonically_increasing_id())


def values(n: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 75 + (25 * n * documents) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def occurrences(table: pa.Table, documents: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the document in the table, term, value) of all postings of a table of scan()."""
    (term, held), (tf, _) = numbers(table.column("terms"), "<i4"), numbers(table.column("tfs"), "<i4")
    n = table.column("n").to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(n)), held), term.astype(np.int64), values(np.repeat(n, held), tf.astype(np.int64), documents, length)


def postings(scanned: DataFrame, documents: int, length: int, ranges_of_docs: int) -> DataFrame:
    """part, term, top, rows, vals: the list of each term and range of documents, largest values first."""

    def build(table: pa.Table) -> pa.Table:
        doc, term, v = occurrences(table, documents, length)
        row = table.column("row").to_numpy().astype(np.int64)[doc]
        order = np.lexsort((row, -v, term))
        term, v, row = term[order], v[order], row[order]
        at = np.flatnonzero(distinct_at(term))
        first = np.append(at, len(term))
        part = np.full(len(at), table.column("part")[0].as_py() if table.num_rows else 0, np.int32)
        return pa.table({"part": part, "term": term[at].astype(np.int32), "top": v[at], "rows": binaries(row.astype("<i8"), first), "vals": binaries(v.astype("<i8"), first)})

    dealt = scanned.where(F.length("terms") > 0).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(ranges_of_docs)).cast("int"))
    return dealt.select("part", "row", "n", "terms", "tfs").groupBy("part").applyInArrow(build, "part int, term int, top long, rows binary, vals binary")


def exact(pairs: DataFrame, scanned: DataFrame, q: Queries, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """q, row, doc_id, score: the looked-up scores of (q, row)."""
    sent = pairs.sparkSession.sparkContext.broadcast((q, weights))
    joined = pairs.join(scanned, "row").select("q", "row", "doc_id", "n", "terms", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = sent.value
        for batch in batches:
            doc, term, v = occurrences(pa.Table.from_batches([batch]), documents, length)
            limits, scores = np.searchsorted(doc, np.arange(batch.num_rows + 1)), []
            for k, one in enumerate(batch.column(0).to_pylist()):
                own = q.of(q.at[one])
                mine, s = q.terms[own], slice(int(limits[k]), int(limits[k + 1]))
                at = np.searchsorted(term[s], mine)
                hit = at < len(term[s])
                hit[hit] = term[s][at[hit]] == mine[hit]
                scores.append(int((w[mine[hit]] * q.repeats[own][hit] * v[s][at[hit]]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.int64())], names=["q", "row", "doc_id", "score"])

    return joined.mapInArrow(run, "q long, row long, doc_id long, score long")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with score above 0, and their rank."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answer(docs: DataFrame, ids: list[int], bags: list[list[str]], k: int, range_docs: int, block: int) -> DataFrame:
    """q, rank, doc_id, score of one chunk of queries."""
    spark = docs.sparkSession
    words = sorted({t for b in bags for t in b})
    index = {t: i for i, t in enumerate(words)}
    q = Queries(ids, [[index[t] for t in b] for b in bags], block)
    scanned = materialize(scan(docs, Vocabulary(words)), "scanned")
    documents, length = scanned.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(words), np.int64)
        for batch in batches:
            seen += np.bincount(numbers(batch.column(0), "<i4")[0], minlength=len(words))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["term", "df"])

    def by_term(df: DataFrame, column: str) -> np.ndarray:
        """A number for each term of the chunk."""
        out = np.zeros(len(words), np.int64)
        for row in df.collect():
            out[row["term"]] = row[column]
        return out

    df = by_term(scanned.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")), "df")
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    lists = materialize(postings(scanned, documents, length, max(1, documents // range_docs)).repartition("term"), "postings")
    tops = by_term(lists.groupBy("term").agg(F.max("top").alias("top")), "top")

    def sent(limits: np.ndarray, cut: int | None) -> DataFrame:
        """block, part, term, rows, vals: what lists send for the queries' limits, the first ``cut`` entries at most."""
        least = spark.sparkContext.broadcast(least_values(q, weights, limits, len(words)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (row, held), (v, _) = numbers(batch.column(3), "<i8"), numbers(batch.column(4), "<i8")
                first, term = np.cumsum(held) - held, batch.column(1).to_numpy()
                each = np.repeat(np.arange(batch.num_rows), held)
                place = np.arange(len(v)) - first[each]
                for b in range(least.value.shape[0]):
                    need = least.value[b][term]
                    keep = (need[each] >= 0) & (v >= need[each])
                    if cut is not None:
                        keep &= place < cut
                    n = np.bincount(each[keep], minlength=batch.num_rows)
                    some = np.flatnonzero(n)
                    if len(some):
                        limits_of = np.concatenate([[0], np.cumsum(n[some])])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), b, np.int32)), batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), binaries(row[keep], limits_of), binaries(v[keep], limits_of)],
                            names=["block", "part", "term", "rows", "vals"],
                        )

        return lists.select("part", "term", "top", "rows", "vals").mapInArrow(run, "block int, part int, term int, rows binary, vals binary")

    def heads(table: pa.Table) -> pa.Table:
        m, out = Meeting(table), []
        for i in q.block(table.column("block")[0].as_py()):
            got, _ = m.sums(q, i, weights, 1)
            for d in np.argsort(-got, kind="stable")[:k].tolist():
                if got[d]:
                    out.append((int(q.ids[i]), int(m.docs[d]), int(got[d])))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("q", "row", "sum"), zip(*out, strict=True) if out else ((), (), ()), strict=True)})

    firsts = sent(np.ones(len(q.ids), np.int64), k).groupBy("block", "part").applyInArrow(heads, "q long, row long, sum long")
    leading = Window.partitionBy("q").orderBy(F.desc("sum"), "row")
    known = exact(firsts.withColumn("at", F.row_number().over(leading)).where(F.col("at") <= k).select("q", "row"), scanned, q, weights, documents, length)
    bounds = np.zeros(len(q.ids), np.int64)
    for one, low, n in known.groupBy("q").agg(F.min("score"), F.count(F.lit(1))).collect():  # a row for each query of the chunk
        bounds[q.at[one]] = low if n == k else 0
    limits = thresholds(q, weights, tops, bounds)

    def candidates(table: pa.Table) -> pa.Table:
        m, out = Meeting(table), []
        for i in q.block(table.column("block")[0].as_py()):
            got, bound = m.sums(q, i, weights, int(limits[i]), tops)
            found = m.docs[(got > 0) & (bound >= bounds[i])]
            out.append(np.stack([np.full(len(found), q.ids[i]), found]))
        both = np.concatenate(out, axis=1)
        return pa.table({"q": both[0], "row": both[1]})

    arrived = materialize(sent(limits, None), "arrived")
    sums = arrived.groupBy("block", "part").applyInArrow(heads, "q long, row long, sum long").withColumn("at", F.row_number().over(leading)).where(F.col("at") == k)
    for one, low in sums.select("q", "sum").collect():  # a row for each query of the chunk
        bounds[q.at[one]] = max(bounds[q.at[one]], low)
    chosen = materialize(arrived.groupBy("block", "part").applyInArrow(candidates, "q long, row long"), "candidates")
    out = materialize(best(exact(chosen, scanned, q, weights, documents, length), k).select("q", "rank", "doc_id", "score"), "ranked")
    discard(scanned, lists, arrived, chosen)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = K, chunk_terms: int = CHUNK_TERMS, range_docs: int = RANGE_DOCS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""

    def tokenise(parts: Iterator) -> Iterator[dict]:
        for ids, texts in parts:
            yield {"item_id": ids, "terms": terms_of(texts)}

    queries = materialize(map_texts(items, tokenise, "item_id long, terms array<string>", ("item_id", "text")).withColumn("q", F.monotonically_increasing_id()), "queries")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    chunks, answers = max(1, -(-total // chunk_terms)), []
    for c in range(chunks):
        own = queries.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("q"), F.lit(chunks)) == c)).orderBy("q").collect()  # about chunk_terms terms
        if own or not c:
            answers.append(answer(docs, [r.q for r in own], [r.terms for r in own], k, range_docs, block))
    return reduce(DataFrame.unionByName, answers).join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
