"""Exact dedup of incoming batches against immutable snapshots.

A snapshot keeps one row for each distinct text digest, dealt over hash buckets, and a
static 3-wise binary-fuse filter for each bucket. The digests of a new batch are first
grouped among themselves (new-batch duplicates, a map-side combine, so a text that holds
a third of all rows is one row from there on), then screened by the filters of every
snapshot before it. Only positives join the snapshots' exact buckets, where the
representatives' bytes are compared; a filter's false positive finds no partner there.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null
doc_id is less than all others; a doc_id may repeat with other texts, each row is judged
by its own; of rows that repeat one doc_id and text, one at most is kept; other columns,
clashing names included, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, map_texts, materialize, mix64, run_dir, split_batch

#: Digests that a bucket, and so one filter and one task's group, holds on average.
BUCKET_DIGESTS = 200_000
#: Batches that one table is cut into: the snapshots, and the incoming one.
BATCHES = 3


class BinaryFuse8:
    """A static filter of about 9 bits a key; keys are distinct uint64."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray) -> None:
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(seed))
        start = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        base = start.astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        slots = np.stack([
            base + (h & mask).astype(np.int64),
            base + segment + ((h >> np.uint64(18)) & mask).astype(np.int64),
            base + 2 * segment + ((mix64(h) >> np.uint64(7)) & mask).astype(np.int64),
        ])
        return slots, (mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(56)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, math.ceil(n * factor / segment) - 2)
        for attempt in range(200):
            seed = int(mix64(np.array([attempt + 1], np.uint64))[0])
            if attempt % 20 == 19:  # a very small set may need more room
                count += 1 + count // 10
            slots, prints = cls._slots(keys, seed, segment, count)
            size = (count + 2) * segment
            order = cls._peel(slots, size)
            if order is None:
                continue
            cells = np.zeros(size, np.uint8)
            for owned, at in reversed(order):
                s = slots[:, owned]
                cells[at] = 0
                cells[at] = prints[owned] ^ cells[s[0]] ^ cells[s[1]] ^ cells[s[2]]
            return cls(seed, segment, count, cells)
        raise RuntimeError("no filter found: the keys are not distinct")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot each owns): in a round, every key that is alone in a slot goes."""
        live, order = np.arange(slots.shape[1]), []
        while len(live):
            s = slots[:, live]
            load = np.bincount(s.ravel(), minlength=size)
            alone = load[s] == 1
            gone = alone.any(axis=0)
            if not gone.any():
                return None
            pick = np.argmax(alone[:, gone], axis=0)
            order.append((live[gone], s[:, gone][pick, np.arange(int(gone.sum()))]))
            live = live[~gone]
        return order

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        s, prints = self._slots(keys, self.seed, self.segment, self.count)
        return (self.cells[s[0]] ^ self.cells[s[1]] ^ self.cells[s[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.uint64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse8:
        seed, segment, count = np.frombuffer(data[:24], np.uint64).tolist()
        return cls(seed, segment, count, np.frombuffer(data[24:], np.uint8))


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return b"" if text is None else text.encode().lower()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), n_bytes."""

    def scan(parts: Iterator) -> Iterator[dict]:
        for ids, texts in parts:
            raw = [normalised(t) for t in texts]
            yield {"doc_id": ids, "digest": [hashlib.sha256(r).digest() for r in raw], "n_bytes": [len(r) for r in raw]}

    return map_texts(docs, scan, "doc_id long, digest binary, n_bytes long")


def _digest(text: Column) -> Column:
    """digests()' digest, as an expression."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(F.encode(low, "UTF-8"), 256))


def _bucket(buckets: int, at: int = 1) -> Column:
    """A digest's bucket, from its four bytes at a place that the filters' keys don't use."""
    return (F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def _keys(column: pa.Array) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)[:, 1].copy() if raw else np.empty(0, np.uint64)


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket, buckets, filter: a binary-fuse filter for each of the buckets that the snapshot's
    distinct digests are dealt over."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.unique(_keys(table.column("digest").combine_chunks()))
        one = {"bucket": table.column("bucket")[0].as_py(), "buckets": buckets, "filter": BinaryFuse8.build(keys).to_bytes()}
        return pa.Table.from_pylist([one], pa.schema([("bucket", pa.int32()), ("buckets", pa.int32()), ("filter", pa.binary())]))

    return snapshot.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket int, buckets int, filter binary")


def snapshot_marks(groups: DataFrame) -> dict[int, tuple[int, str]]:
    """For each batch of groups (batch, digest) its number of rows and a mark of what it holds: that number with the
    sum and the exclusive or of two 64-bit hashes of its digests, so other digests have another mark."""
    a, b = F.xxhash64("digest"), F.xxhash64("digest", F.lit(1))
    found = groups.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(b).cast("string").alias("mixed"))
    return {r.batch: (r.n, hashlib.sha256(f"{r.n} {r.total} {r.mixed}".encode()).hexdigest()[:32]) for r in found.collect()}


def stored_filters(snapshot: DataFrame, n: int, path: str) -> DataFrame:
    """The filters of a snapshot of n digests as the Parquet table at ``path``: built and written
    the first time, read from then on. A path must hold the snapshot's mark, so that another snapshot has another path."""
    spark = snapshot.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build_filters(snapshot, max(1, math.ceil(n / BUCKET_DIGESTS))).write.mode("overwrite").parquet(path)
    return spark.read.schema("bucket int, buckets int, filter binary").parquet(path)


def screen(incoming: DataFrame, filters: DataFrame, n: int) -> DataFrame:
    """n incoming rows (digest, n_bytes, batch) with ``maybe``: false only if the snapshot lacks the digest.

    Where they outnumber the snapshot, a bucket's rows are dealt over several tasks by other bits of
    the digest and its filter is copied to each, so that a small snapshot's few buckets bound no task."""
    buckets = filters.agg(F.coalesce(F.max("buckets"), F.lit(1))).first()[0]
    parts = max(1, math.ceil(n / (buckets * BUCKET_DIGESTS)))

    def probe(rows: pa.Table, own: pa.Table) -> pa.Table:
        if own.num_rows and rows.num_rows:
            hit = BinaryFuse8.from_bytes(own.column("filter")[0].as_py()).might_contain(_keys(rows.column("digest").combine_chunks()))
        else:
            hit = np.zeros(rows.num_rows, bool)
        return rows.select(["digest", "n_bytes", "batch"]).append_column("maybe", pa.array(hit, pa.bool_()))

    dealt = incoming.select("digest", "n_bytes", "batch", _bucket(buckets).alias("bucket"), _bucket(parts, 17).alias("part")).groupBy("bucket", "part")
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.cogroup(copies.groupBy("bucket", "part")).applyInArrow(probe, "digest binary, n_bytes long, batch int, maybe boolean")


def _bytes_differ(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The digests (of reps: digest, doc_id) that stand for normalised texts of different bytes.
    A text is found by its doc_id and its own digest, so a doc_id may repeat with other texts."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 1):
                raw = [normalised(t) for t in part.column(1).to_pylist()]
                digest = pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), digest, pa.array(raw, pa.binary())], names=["doc_id", "digest", "_raw"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(normal, "doc_id long, digest binary, _raw binary")
    texts = read.select(*_key("doc_id"), "digest", "_raw")
    # a merge join at every size: neither side has a bound that would let it be broadcast
    found = reps.select(*_key("doc_id"), "digest").join(texts.hint("merge"), ["_id", "_null", "digest"])
    return found.groupBy("digest").agg(F.min("_raw").alias("a"), F.max("_raw").alias("b")).where("a <> b").select("digest")


def _key(name: str) -> list[Column]:
    """A doc_id as join columns, under which null equals null."""
    return [F.coalesce(name, F.lit(0)).alias("_id"), F.col(name).isNull().alias("_null")]


def by_crc(batches: int = BATCHES) -> Column:
    """A batch for each row of one table: the last takes half of them and all without a doc_id."""
    crc = F.crc32(F.col("doc_id").cast("string")) % (2 * (batches - 1))
    return F.coalesce(F.least(crc, F.lit(batches - 1)), F.lit(batches - 1)).cast("int")


def dedup(docs: DataFrame, batch: Column | None = None, batches: int = BATCHES, store: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, batch for every row of docs.

    ``batch`` (default: by_crc()) numbers each row's batch from 0. The last batch is the incoming
    one, those before it are immutable snapshots; which row is where changes nothing in the groups.
    With ``store``, a snapshot's filters are kept as Parquet in that folder, under a mark of its digests
    and its number, and used again for a snapshot of the same digests alone; filters of others stay unread. Texts whose bytes differ under one SHA-256 would stop the job (`raise_error`)
    rather than be merged."""
    rows = digests(docs).withColumn("batch", by_crc(batches) if batch is None else batch).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "digests")
    groups = rows.groupBy("batch", "digest", "n_bytes").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "grouped")
    marks = snapshot_marks(groups)
    folder = store or f"{run_dir(docs.sparkSession)}/filters-{uuid.uuid4().hex}"
    maybe = [groups.where("false").select("digest", "n_bytes", "batch")]
    for k in range(batches - 1):
        later = sum(n for b, (n, _) in marks.items() if b > k)
        if k not in marks or not later:  # nothing to hold, or nothing to look up
            continue
        n, mark = marks[k]
        filters = stored_filters(groups.where(F.col("batch") == k), n, f"{folder}/{mark}/snapshot={k}")
        maybe.append(screen(groups.where(F.col("batch") > k), filters, later).where("maybe").select("digest", "n_bytes", "batch"))
    positive = materialize(reduce(DataFrame.unionByName, maybe), "positive")
    held = groups.where(F.col("batch") < batches - 1).select("digest", "n_bytes", F.col("batch").alias("held"))
    hits = materialize(positive.join(held, ["digest", "n_bytes"]).where("held < batch").select("digest").distinct(), "hits")
    met = materialize(groups.join(hits, "digest"), "met")
    clash = _bytes_differ(met.select("digest", "top.doc_id"), docs).select("digest", F.lit(True).alias("clash"))
    merged = met.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n")).join(clash, "digest", "left").select(
        "digest", F.when(F.col("clash"), F.raise_error(F.lit("two texts share one SHA-256")).cast("long")).otherwise(F.col("n")).alias("n"), "top"
    )
    alone = groups.where("n > 1").join(hits, "digest", "left_anti").select("digest", "n", "top")
    # written, so that the join below reads two plain exchanges and a hot digest can be split
    shared = materialize(alone.unionByName(merged).select("digest", F.col("n").alias("group_size"), F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row")), "groups")
    discard(groups, positive, hits, met)
    return rows.join(shared, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "batch",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that dedup() keeps: one of each group of equal texts."""
    judged = dedup(docs).groupBy(*_key("doc_id"), F.unhex("text_sha256").alias("_digest"))
    flags = judged.agg(F.bool_or("kept").alias("_stays"), F.count(F.lit(1)).alias("_n")).where("not _stays or _n > 1")
    names = {c: fresh(docs, c) for c in ("_id", "_null", "_digest", "_stays")}
    key = [names[c] for c in ("_id", "_null", "_digest")]
    flags = materialize(flags.select(*[F.col(c).alias(n) for c, n in names.items()]), "flags")
    id_, null = _key("doc_id")
    keyed = docs.withColumns({names["_id"]: id_, names["_null"]: null, names["_digest"]: _digest(F.col("text"))})
    joined = keyed.join(flags.hint("merge"), key, "left")
    stays = F.col(names["_stays"])
    out = joined.where(stays.isNull())
    if not flags.where(stays).isEmpty():  # rows that repeat a doc_id and a text that stays: one of them
        out = out.unionByName(joined.where(stays).dropDuplicates(key))
    return out.select(*docs.columns)
