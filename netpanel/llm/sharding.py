"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group, and a group is what is placed: in descending order, to the shard
where the dot product of its vector (bytes, tokens, rows) with the residual capacity is
highest. Groups that hold much of the corpus are few, as their share has a floor; the
driver places them first. All others are dealt by hash to tasks of about TASK_GROUPS; each
task places its groups, one by one, into its proportional part of the capacity that is
left, so tasks need not know of each other. In every placement swaps and moves then narrow
the differences, first of all three sums, at last of the bytes. A group of more than half
a shard can't stay whole if shards are to be equal: its rows are dealt over parts.

Every row gets a slot: its cell's offset in the shard plus its place in the cell, a cell
being a part of a task's groups in one shard, or a large group's part.

Defined cases: a null text has size 1; empty texts are one group; equal rows are placed
together like all rows of one text; an empty table gives an empty result; other columns are
ignored. Rows with a null doc_id take the first slots of their cell, in no stated order
among themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize

#: A group above 1/BIG_PARTS of all bytes, tokens or rows is placed by the driver: 3 * BIG_PARTS rows at most.
BIG_PARTS = 1024
#: Groups that one task places, and tasks at most (beyond it, tasks place more).
TASK_GROUPS, MAX_TASKS = 50_000, 4096
#: Cells of one task and shard; all cells together stay below 8 * MAX_TASKS for 8 shards.
CELLS = 64
#: Swaps that a placement tries for all sums, the groups that one of them chooses among, and swaps for bytes alone.
SWAPS, CHOICE, BYTE_SWAPS = 300, 256, 400
#: What a difference in bytes, tokens and rows weighs.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, digest of each row."""

    def scan(parts: Iterator) -> Iterator[dict]:
        for ids, texts in parts:
            raw = [b"" if t is None else t.encode() for t in texts]
            yield {
                "doc_id": ids,
                "size": [len(r) + 1 for r in raw],
                "text_crc32": [zlib.crc32(r) for r in raw],
                "tokens": [len(r.split()) for r in raw],
                "digest": [hashlib.blake2b(r, digest_size=16).digest() for r in raw],
            }

    return map_texts(docs, scan, "doc_id long, size long, text_crc32 long, tokens long, digest binary")


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each vector (bytes, tokens, rows); capacity: shards x 3, in the same units."""
    total = np.maximum(vectors.sum(axis=0), 1)
    share, residual = vectors / total, capacity / total
    where = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable").tolist():
        own = share[i]
        room = residual >= own
        fits = room.all(axis=1)
        if not fits.any():
            fits = room[:, 0]
        to = int(np.argmax(np.where(fits, residual @ own, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        where[i] = to
        residual[to] -= own
    _even_sums(where, share, -residual)
    _even_bytes(where, vectors, capacity[:, 0])
    return where


def _even_sums(where: np.ndarray, share: np.ndarray, over: np.ndarray) -> None:
    """Swaps and moves between the two shards that differ most in some sum, each the best for all
    three of CHOICE by CHOICE groups; over: what each shard holds beyond its capacity."""
    rng, idle = np.random.default_rng(0), 0
    for _ in range(SWAPS):
        sum_ = int(np.argmax((over.max(axis=0) - over.min(axis=0)) * np.sqrt(WEIGHTS)))
        high, low = int(np.argmax(over[:, sum_])), int(np.argmin(over[:, sum_]))
        mine, theirs = np.flatnonzero(where == high), np.flatnonzero(where == low)
        if idle == 10 or not len(mine):
            break
        mine = mine if len(mine) <= CHOICE else rng.choice(mine, CHOICE, replace=False)
        theirs = theirs if len(theirs) <= CHOICE else rng.choice(theirs, CHOICE, replace=False)
        back = np.vstack([share[theirs], np.zeros(3)])  # the last: a move without return
        gap = over[high] - over[low]
        after = gap - 2 * (share[mine][:, None] - back[None])
        left = (after * after) @ WEIGHTS
        i, j = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[i, j] >= gap * gap @ WEIGHTS * (1 - 1e-9):
            idle += 1
            continue
        idle = 0
        where[mine[i]] = low
        if j < len(theirs):
            where[theirs[j]] = high
        moved = share[mine[i]] - back[j]
        over[high] -= moved
        over[low] += moved


def _even_bytes(where: np.ndarray, vectors: np.ndarray, capacity: np.ndarray) -> None:
    """Swaps that narrow the bytes alone, of groups of equally many rows while there are such."""
    sizes, rows = vectors[:, 0].astype(np.int64), vectors[:, 2]
    target = np.round(capacity * (sizes.sum() / max(capacity.sum(), 1))).astype(np.int64)
    usual = rows == np.median(rows) if len(rows) else rows > 0
    for _ in range(BYTE_SWAPS):
        over = np.bincount(where, weights=sizes, minlength=len(capacity)).astype(np.int64) - target
        high, low = int(np.argmax(over)), int(np.argmin(over))
        gap = int(over[high] - over[low])
        if gap <= 1:
            break
        done = False
        for among, give_nothing in ((usual, False), (np.ones(len(rows), bool), True)):
            mine, theirs = np.flatnonzero((where == high) & among), np.flatnonzero((where == low) & among)
            order = theirs[np.argsort(sizes[theirs], kind="stable")]
            give = np.concatenate([[0] if give_nothing else [], sizes[order]])
            if not len(mine) or not len(give):
                continue
            want = sizes[mine] - gap // 2
            at = np.clip(np.searchsorted(give, want), 0, len(give) - 1)
            at = np.where((at > 0) & (np.abs(give[at - 1] - want) <= np.abs(give[at] - want)), at - 1, at)
            after = np.abs(gap - 2 * (sizes[mine] - give[at]))
            best = int(np.argmin(after))
            if after[best] < gap:
                where[mine[best]] = low
                back = int(at[best]) - give_nothing
                if back >= 0:
                    where[order[back]] = high
                done = True
                break
        if not done:
            break


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), tokens, cell."""
    spark = docs.sparkSession
    rows = materialize(measures(docs).withColumn("row", F.monotonically_increasing_id()), "measures")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "groups")
    found = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "btn"), F.count(F.lit(1))).first()
    total, n_groups = np.maximum(np.array(found[:3], float), 1), found[3]
    weight = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip("btn", total, strict=True))) * BIG_PARTS
    big = groups.where(weight > 1).withColumn("parts", F.ceil(weight).cast("int")).withColumn("whole", weight * 2 * shards <= BIG_PARTS).toPandas()
    big["at"] = big["parts"].cumsum() - big["parts"]  # at most 3 * BIG_PARTS groups, and twice as many parts
    named = spark.createDataFrame([(bytes(d), int(p), int(a)) for d, p, a in zip(big["digest"], big["parts"], big["at"], strict=True)], "digest binary, parts int, at int")
    held = rows.join(F.broadcast(named), "digest").withColumn("at", (F.col("at") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    parts = held.groupBy("at").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("at")
    sums = parts[["b", "t", "n"]].to_numpy(float)
    owner = np.searchsorted(big["at"].to_numpy(), parts["at"].to_numpy(), "right") - 1
    # what is placed: a group, of whose parts each is a cell, or a part of a group that is too large
    item = np.unique(np.where(big["whole"].to_numpy(bool)[owner], big["at"].to_numpy()[owner], parts["at"].to_numpy()), return_inverse=True)[1]
    items = np.stack([np.bincount(item, sums[:, k], item.max(initial=-1) + 1) for k in range(3)], axis=1)
    where = place(items, np.tile(total / shards, (shards, 1)))[item]
    placed = np.zeros((shards, 3))
    np.add.at(placed, where, sums)
    rest = np.maximum(total / shards - placed, 1e-9 * total)
    rest /= rest.sum(axis=0)  # each shard's part of what all tasks together place

    tasks = min(MAX_TASKS, max(1, -(-n_groups // TASK_GROUPS)))
    cells = max(1, min(CELLS, MAX_TASKS // tasks))

    def deal(table: pa.Table) -> pa.Table:
        v = np.stack([table.column(c).to_numpy() for c in "btn"], axis=1).astype(float)
        to = place(v, rest * v.sum(axis=0))
        salt = np.frombuffer(b"".join(d.as_py()[:4] for d in table.column("digest")), "<u4") % cells
        cell = (table.column("task")[0].as_py() * shards + to) * cells + salt
        return pa.table({"digest": table.column("digest"), "n": table.column("n"), "cell": pa.array(cell, pa.int32())})

    small = groups.join(F.broadcast(named), "digest", "left_anti").withColumn("task", F.pmod(F.xxhash64("digest"), F.lit(tasks)).cast("int"))
    homes = materialize(small.groupBy("task").applyInArrow(deal, "digest binary, n long, cell int"), "homes")
    first = tasks * shards * cells  # the large groups' cells come after all others
    stats = homes.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    plan = [(int(c), int(c) // cells % shards, int(n)) for c, n in zip(stats["cell"], stats["n"], strict=True)]
    plan += [(first + int(a), int(to), int(n)) for a, n, to in zip(parts["at"], parts["n"], where, strict=True)]
    base, numbered = [0] * shards, []
    for cell, to, n in sorted(plan):
        numbered.append((cell, to, base[to]))
        base[to] += n
    plan = spark.createDataFrame(numbered, "cell int, shard int, base long")  # shards * MAX_TASKS and the large groups' parts at most
    columns = ["doc_id", "size", "text_crc32", "tokens", "cell"]
    dealt = rows.join(F.broadcast(named), "digest", "left_anti").join(homes.select("digest", "cell"), "digest").select(*columns)
    dealt = dealt.unionByName(held.withColumn("cell", F.col("at") + first).select(*columns))
    discard(groups)
    place_in_cell = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    return (
        dealt.withColumn("place", place_in_cell)
        .join(F.broadcast(plan), "cell")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "tokens", "cell",
        )
    )
