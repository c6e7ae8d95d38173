"""What the corpus operators share: written intermediate tables, Arrow batches of
texts, and vectorised hashes of the words of many texts at once."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step looks at; bounds the memory of a task.
CHUNK_BYTES = 2 << 20
#: Words of at least so many bytes are hashed by blake2b instead of the polynomial.
LONG_WORD = 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gaps_around(*kept: tuple[int, int]) -> np.ndarray:
    """For each byte whether it lies between words; kept: ranges (both ends in) that words are made of."""
    out = np.ones(256, bool)
    for low, high in kept:
        out[low : high + 1] = False
    return out


#: Between words of ASCII letters and all beyond ASCII; the same with digits in words.
NOT_LETTERS = gaps_around((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_ALPHANUMERIC = gaps_around((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_runs: set[str] = set()
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local master that names none (tests) gets a
    temporary folder; a cluster without one is an error, as its executors share no disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            found = set_dir.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='netpanel-')}"
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables. It goes when the program ends;
    purge() deletes it earlier."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs.add(path)
        atexit.register(_delete, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def _delete(jvm, conf, path: str) -> None:  # noqa: ANN001
    p = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        p.getFileSystem(conf).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: for when its results are written."""
    _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), run_dir(spark))


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """Garbage collection off while a task fills caches of millions of objects without cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage,
    survives lost executors, and keeps a costly scan from running twice."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), df._materialized)


def map_texts(
    docs: DataFrame,
    fn: Callable[[Iterator[tuple[list, list]]], Iterator[dict]],
    schema: str,
    columns: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """``fn`` gets an iterator of column lists (``columns``, whole rows, about
    CHUNK_BYTES of text at a time) and yields dicts of result columns."""
    out = pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[list, ...]]:
            for batch in batches:
                for part in split_batch(batch, len(columns) - 1):
                    yield tuple(part.column(i).to_pylist() for i in range(part.num_columns))

        for cols in fn(parts()):
            arrays = [pa.array(cols[f.name], type=f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    selected = docs.select(*columns)
    shaped = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(shaped)
    return selected.mapInArrow(run, shaped)


def split_batch(batch: pa.RecordBatch, text_at: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, one row at least."""
    lengths = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 1
    if batch.num_rows > start:
        yield batch.slice(start)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _BASE_INV):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def _hash_span(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix64(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` (or what lies between other gaps) of a list of texts (None: no words).

    buf: bytes of all texts, a line feed after each; starts, ends: of each word in
    buf; first: index of each text's first word, with the number of words at the end."""

    def __init__(self, texts: list[str | None], lower: bool = False, gaps: np.ndarray = _SPACE) -> None:
        self._cut([b"" if t is None else t.encode() for t in texts], lower, gaps)

    @classmethod
    def of_bytes(cls, raw: list[bytes]) -> Words:
        out = cls.__new__(cls)
        out._cut(raw, False, _SPACE)
        return out

    def _cut(self, raw: list[bytes], lower: bool, gaps: np.ndarray) -> None:
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        space = gaps[self.buf]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.starts, limits[: len(raw) + 1])

    def hashes(self) -> np.ndarray:
        """A uint64 for each word; equal words have equal hashes wherever they stand."""
        n = len(self.starts)
        out = np.empty(n, np.uint64)
        long = np.flatnonzero(self.ends - self.starts >= LONG_WORD)
        at = 0
        while at < n:
            base = self.starts[at]
            to = max(int(np.searchsorted(self.ends, base + CHUNK_BYTES, "right")), at + 1)
            if self.ends[to - 1] - base <= CHUNK_BYTES + LONG_WORD:
                span = self.buf[base : self.ends[to - 1]]
                out[at:to] = _hash_span(span, self.starts[at:to] - base, self.ends[at:to] - base)
            at = to
        for i in long.tolist():
            word = self.buf[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def distinct_at(sorted_values: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal values."""
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


def rolling(h: np.ndarray, k: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of k consecutive values of h (by Horner's rule, then mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(factor)
        out += h[i : i + n]
    return mix64(out)
