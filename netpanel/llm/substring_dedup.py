"""Removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash among its word
M-grams; consecutive windows that share a minimiser form a super-k-mer, whose words
travel once, as one packed string, to the minimiser's bucket. Equal windows have equal
minimisers, so all occurrences of a window meet in one bucket, where sorting by window
puts them side by side; equal hashes are confirmed on the bytes. A window is repeated if
an occurrence starts earlier (smaller doc_id, then earlier start).

Before anything is shuffled, equal super-k-mers of a task are reduced to the earliest
and the others' windows are marked at once: a passage that a third of all documents
share is one string a task from there on. Strings of a bucket are packed together and
compressed; the number of buckets follows the size of the corpus.

A minimiser that very many windows share would fill its bucket. So a first pass counts the
windows of each minimiser (by a 32-bit code of it), exactly for all that may be overfull:
if its total reaches LIMIT, some task holds at least its share by bytes, so each task
reports those with half of that share. Windows of an overfull minimiser are dealt by their
own hash instead; equal windows still meet.

Defined cases: a null text has no words; texts under WINDOW words lose nothing; a null
doc_id counts as greater than all others; repeated rows of one doc_id and text neither
give to nor take from each other but lose the same words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, rolling, split_batch

WINDOW = 20
#: Words of the grams among which the minimiser is.
GRAM = 3
#: Windows that a super-k-mer has at most.
RUN = 256
#: Bytes of packed words that a bucket should hold, and that a task gathers before it sends.
BUCKET_BYTES, FLUSH_BYTES = 10 << 20, 16 << 20
#: Packed words for each byte of text: (WINDOW - GRAM + 2) / 2 windows share WINDOW - 1 words.
EXPANSION = 3.1
LAST = (1 << 63) - 1
#: Windows of a minimiser that may meet in its bucket (in corpora of over LIMIT << 23 bytes, one for each 2 ** 23 bytes).
LIMIT = 200_000
#: Codes of minimisers that a task of the first pass gathers before it adds them up.
GATHER = 1 << 22
#: Level of the strings' compression.
LEVEL = 6

ENTRY = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i8"), ("n", "<i4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + n] and buf[b : b + n] agree, for arrays a, b, n; 8 bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    at = 0
    while len(live):
        left = n[live] - at
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.clip(left, 0, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        differ = ((eight[a[live] + at] ^ eight[b[live] + at]) & mask) != 0
        same[live[differ]] = False
        at += 8
        live = live[~differ & (left > 8)]
    return same


def earlier(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the entry of equal key that is earliest, and whether it is earlier still than itself."""
    order = np.lexsort((start, doc, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.empty(len(k), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    before = (doc[first] < doc) | ((doc[first] == doc) & (start[first] < start))
    return first, before


def minimisers(w: Words, texts: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of WINDOW words of all texts: the text of its first word, whether it lies
    in one text, and its minimiser."""
    owner = np.repeat(np.arange(texts), np.diff(w.first))
    valid = owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :]
    return owner, valid, sliding_min(rolling(h, GRAM), WINDOW - GRAM + 1)


def code(least: np.ndarray) -> np.ndarray:
    """32 bits of a minimiser; mixed, as least values have small leading bits."""
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def words_of(raw: list[bytes]) -> Words:
    return Words.of_bytes([b" ".join(r.split()) for r in raw])


class Counts:
    """Windows of each minimiser code that a task has met."""

    def __init__(self) -> None:
        self.codes, self.n = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.held = self.bytes = 0

    def add(self, raw: list[bytes]) -> None:
        self.bytes += sum(map(len, raw))
        w = words_of(raw)
        if len(w.starts) >= WINDOW:
            _, valid, least = minimisers(w, len(raw), w.hashes())
            self.parts.append(code(least[valid]))
            self.held += len(self.parts[-1])
            if self.held > GATHER:
                self.fold()

    def fold(self) -> None:
        found, n = np.unique(np.concatenate([np.empty(0, np.uint32), *self.parts]), return_counts=True)
        codes, at = np.unique(np.concatenate([self.codes, found]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(codes)).astype(np.int64)
        self.codes, self.parts, self.held = codes, [], 0

    def above(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        many = self.n >= least
        return self.codes[many], self.n[many]


def overfull(docs: DataFrame, total: int, limit: int) -> np.ndarray:
    """Sorted codes of all minimisers with ``limit`` windows or more (total: bytes of all texts),
    and of some with half as many. At most one for each limit / 2 windows of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for part in split_batch(batch, 0):
                counts.add([b"" if t is None else t.encode() for t in part.column(0).to_pylist()])
        codes, n = counts.above(limit * counts.bytes / (2 * max(total, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["code", "n"])

    found = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= limit / 2)
    return np.sort(found.select("code").toPandas()["code"].to_numpy().astype(np.uint32))


class Packer:
    """Cuts texts into super-k-mers and packs them by bucket; windows of the ``hot`` minimiser
    codes travel one by one, to the bucket of their own hash."""

    def __init__(self, buckets: int, hot: np.ndarray | None = None) -> None:
        self.buckets, self.hot = buckets, np.empty(0, np.uint32) if hot is None else hot
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, docs: np.ndarray, texts_key: np.ndarray, raw: list[bytes]) -> None:
        w = words_of(raw)
        n = len(w.starts)
        if n < WINDOW:
            return
        h = w.hashes()
        owner, valid, least = minimisers(w, len(raw), h)
        whole = rolling(h, WINDOW)
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        if len(self.hot):
            own = code(least)
            at = np.minimum(np.searchsorted(self.hot, own), len(self.hot) - 1)
            hot = self.hot[at] == own
            begins |= valid & hot
            least = np.where(hot, whole, least)
        runs = np.flatnonzero(begins)
        if not len(runs):
            return
        edges = np.flatnonzero(~valid)
        limit = np.append(runs[1:], len(valid))
        k = np.searchsorted(edges, runs)
        limit = np.minimum(limit, np.append(edges, len(valid))[k])
        pieces = -(-(limit - runs) // RUN)
        inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s = np.repeat(runs, pieces) + inner * RUN
        e = np.minimum(s + RUN, np.repeat(limit, pieces))  # windows s .. e - 1
        key = mix64(whole[s] ^ mix64(whole[e - 1] + (e - s).astype(np.uint64)))
        entries = np.empty(len(s), ENTRY)
        d = owner[s]
        entries["doc"], entries["text"] = docs[d], texts_key[d]
        entries["start"], entries["n"] = s - w.first[d], e - s + WINDOW - 1
        begin, end = w.starts[s], w.ends[e + WINDOW - 2]
        first, before = earlier(key, entries["doc"], entries["start"])
        twin = np.flatnonzero(before & (end - begin == (end - begin)[first]))
        twin = twin[same_bytes(w.buf, begin[twin], begin[first[twin]], (end - begin)[twin])]
        known = np.zeros(len(s), bool)
        known[twin] = True
        self.parts.append(((least[s] % np.uint64(self.buckets)).astype(np.int64), key, entries, known, begin, end, w.buf.tobytes()))
        self.bytes += int((end - begin)[~known].sum()) + len(s) * 8

    def flush(self) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that has anything: sizes, the entries with words, the marked entries, the words."""
        if not self.parts:
            return
        bucket, key, entries, known = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        # equal super-k-mers of different chunks: the earliest stays (confirmed on the bytes)
        slices: list[bytes] = []
        for p in self.parts:
            data = p[6]
            slices += [data[a:b] for a, b in zip(p[4].tolist(), p[5].tolist(), strict=True)]
        if len(self.parts) > 1:
            first, before = earlier(key, entries["doc"], entries["start"])
            for i in np.flatnonzero(before & ~known).tolist():
                known[i] = slices[i] == slices[first[i]]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        numbers, blobs = [], []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            mine = order[a:b]
            kept, marked = mine[~known[mine]], mine[known[mine]]
            words = b"\n".join([slices[i] for i in kept.tolist()])
            data = np.array([len(kept), len(marked)], "<i8").tobytes() + by_column(entries[kept]) + by_column(entries[marked]) + words
            numbers.append(int(bucket[mine[0]]))
            blobs.append(np.array([len(data)], "<i8").tobytes() + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True))
            if sum(map(len, blobs)) > FLUSH_BYTES // 4:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
                numbers, blobs = [], []
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
        self.clear()


def by_column(entries: np.ndarray) -> bytes:
    return b"".join(entries[name].tobytes() for name in ENTRY.names)


def of_columns(data: bytes, n: int) -> np.ndarray:
    out, at = np.empty(n, ENTRY), 0
    for name in ENTRY.names:
        out[name] = np.frombuffer(data, ENTRY[name], n, at)
        at += n * ENTRY[name].itemsize
    return out


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    size = int(np.frombuffer(blob[:8], "<i8")[0])
    data = pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
    kept, marked = np.frombuffer(data[:16], "<i8").tolist()
    a = 16 + kept * ENTRY.itemsize
    b = a + marked * ENTRY.itemsize
    return of_columns(data[16:a], kept), of_columns(data[a:b], marked), data[b:]


def intervals(blobs: list[bytes]) -> np.ndarray:
    """Words to remove (doc, text, start, n) that one bucket's occurrences show."""
    found = [unpack(b) for b in blobs]
    done = np.concatenate([m for _, m, _ in found])
    kept = np.concatenate([k for k, _, _ in found])
    if not len(kept):
        return done
    w = Words.of_bytes([t for _, _, t in found])
    h = w.hashes()
    n = kept["n"].astype(np.int64)
    first_word = np.cumsum(n) - n
    per = n - WINDOW + 1
    entry = np.repeat(np.arange(len(kept)), per)
    inside = np.arange(len(entry)) - np.repeat(np.cumsum(per) - per, per)
    at = first_word[entry] + inside
    key = rolling(h, WINDOW)[at]
    doc, start = kept["doc"][entry], kept["start"][entry] + inside
    begin, size = w.starts[at], w.ends[at + WINDOW - 1] - w.starts[at]
    # equal keys of different bytes, however unlikely, get keys of their own and are looked at again
    for salt in range(1, 64):
        first, before = earlier(key, doc, start)
        other = np.flatnonzero(first != np.arange(len(first)))
        wrong = size[other] != size[first[other]]
        check = other[~wrong]
        odd = np.concatenate([other[wrong], check[~same_bytes(w.buf, begin[check], begin[first[check]], size[check])]])
        if not len(odd):
            break
        key = key.copy()
        key[odd] = mix64(key[odd] + np.uint64(salt))
    hit = np.flatnonzero(before)
    if not len(hit):
        return done
    new = np.ones(len(hit), bool)
    new[1:] = (entry[hit[1:]] != entry[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1
    out = np.empty(len(a), ENTRY)
    out["doc"], out["text"] = doc[hit[a]], kept["text"][entry[hit[a]]]
    out["start"], out["n"] = start[hit[a]], hit[b] - hit[a] + WINDOW
    return np.concatenate([done, out])


def marks(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc, text_key, start, n: runs of words that are covered by repeated windows."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if buckets is None:
        buckets = max(1, math.ceil(total * EXPANSION / BUCKET_BYTES))
    # a word and its space have two bytes at least, so no more than 2 ** 23 codes, 32 MB, reach the tasks
    hot = docs.sparkSession.sparkContext.broadcast(overfull(docs, total, max(LIMIT, total >> 23)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, hot.value)
        for batch in batches:
            for part in split_batch(batch, 2):
                raw = [b"" if t is None else t.encode() for t in part.column(2).to_pylist()]
                packer.add(part.column(0).to_numpy(), part.column(1).to_numpy(), raw)
                if packer.bytes >= FLUSH_BYTES:
                    yield from packer.flush()
        yield from packer.flush()

    def judge(t: pa.Table) -> pa.Table:
        found = intervals(t.column("blob").to_pylist())
        return pa.table({"doc": found["doc"], "text_key": found["text"], "start": found["start"], "n": found["n"].astype(np.int64)})

    packed = keyed.mapInArrow(cut, "bucket int, blob binary")
    return packed.groupBy("bucket").applyInArrow(judge, "doc long, text_key long, start long, n long")


def remove(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: the digest stands for the kept words, joined by one space."""
    return _applied(docs, buckets, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def kept_texts(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words joined by one space."""
    return _applied(docs, buckets, "text string", bytes.decode)


def _applied(docs: DataFrame, buckets: int | None, column: str, last) -> DataFrame:  # noqa: ANN001
    own = marks(docs, buckets).groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    # a merge join at every size: texts have no bound that would let either side be broadcast
    joined = keyed.join(own.hint("merge"), ["doc", "text_key"], "left").select("doc_id", "runs", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 2):
                n_words, n_removed, results = [], [], []
                for runs, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    total = len(words)
                    if runs:
                        step = np.zeros(total + 1, np.int64)
                        np.add.at(step, [r["start"] for r in runs], 1)
                        np.add.at(step, [r["start"] + r["n"] for r in runs], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    results.append(last(b" ".join(words)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(results, pa.string())], names=["doc_id", "n_words", "n_removed", column.split()[0]])

    return joined.mapInArrow(apply, f"doc_id long, n_words long, n_removed long, {column}")
