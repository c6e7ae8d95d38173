"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A document costs ``LINEAR * n + QUADRATIC * n * n`` (attention). Within a task,
documents in descending cost go to the sequence of lowest cost, of all, that has room for
them; a document that fits nowhere whole is cut over the sequences of lowest cost that
have room. As many sequences are opened as the task's tokens fill completely; what is over
(less than a sequence a batch) travels on, and is packed again with the rest of other
tasks until few rests remain. So at most one sequence of each last-level task is padded.

Defined cases: a null text counts as empty and an empty text is its end id alone; a null
doc_id is packed like any other; a document longer than a sequence is cut; equal texts
are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, no_collection, split_batch

LENGTH = 4096
END_ID = 2
#: Weights of the cost estimate: tokens, and tokens squared.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Tokens that are packed together in a task; bounds its memory.
BATCH_TOKENS = 1 << 21
#: Rests that one task of the next level gathers.
FAN_IN = 64
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: A longer word is not remembered.
LONG_WORD = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file, as its plain call gives them
    (add_special_tokens=False: nothing is put around a text, but the file's added tokens
    are found in it). Such a file cuts texts into words that are merged independently and
    never hold white space: so a text is split at its added tokens, then at white space,
    each distinct chunk is cut into words once, and each distinct word is encoded once.

    A file of another form is refused. ``plain``: added tokens in a text are ordinary text."""

    #: What str.split() takes for white space but the pattern does not.
    NOT_SPACE = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, plain: bool = False) -> None:
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.pattern, added = self._form(json.load(f))
        self.added = {} if plain else added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))).findall if self.added else None
        self.model = Tokenizer.from_file(path)
        self.words = regex.compile(self.pattern).findall
        self.merge = self.model.model.tokenize
        #: The usual byte-level spelling: printable bytes stand for themselves, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = dict(zip(shown, shown, strict=True)) | {b: 256 + i for i, b in enumerate(hidden)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _form(spec: dict) -> tuple[str, dict[str, bytes]]:
        """The pre-tokenizer's pattern and the ids of the added tokens, of a file that this class can read."""
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        split, spell = spec["pre_tokenizer"].get("pretokenizers", [{}, {}])
        fits = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and spec["normalizer"]["normalizers"][1]["content"] == " "
            and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"].get("Regex", "")
            and spell.get("type") == "ByteLevel" and not spell["add_prefix_space"] and not spell["use_regex"]
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError("not a tokenizer of words that are cut at white space and merged by byte-level BPE")
        return split["pattern"]["Regex"], {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}

    def _chunks(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # there NFC changes nothing and lower() is one to one
            text = text.lower()
        except UnicodeEncodeError:
            text = self.model.normalizer.normalize_str(text)
        if any(c in text for c in self.NOT_SPACE):
            return self.words(text)
        return text.split()

    def _word(self, word: str) -> bytes:
        """Ids of a normalised word by the file's BPE model, on its bytes spelt as characters."""
        spelt = word if word.isascii() else word.encode().decode("latin-1")
        return array("I", [t.id for t in self.merge(spelt.translate(self.spelling))]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split, parts = [], {}
        for i, text in enumerate(texts):
            if self.added and any(c in text for c in self.added):
                parts[i] = (len(split), self.marks(text))
                split += map(self._chunks, self.cut(text))
            else:
                parts[i] = (len(split), ())
                split.append(self._chunks(text))
        ids = self._join(split)
        out = []
        for at, marks in parts.values():
            found = ids[at]
            for k, mark in enumerate(marks, 1):
                found += self.added[mark] + ids[at + k]
            out.append(found)
        return out

    def _join(self, split: list[list[str]]) -> list[bytes]:
        """Ids of each list of chunks."""
        if len(self.cache) > CACHE_WORDS:  # what was last used stays at hand for one generation
            self.older, self.cache = self.cache, {}
        cache, older, word = self.cache, self.older, self._word
        new = set().union(*split).difference(cache)
        for c in new.intersection(older):
            cache[c] = older[c]
        new.difference_update(older)
        mixed = []
        for c in new:
            if c.isalpha():
                cache[c] = word(c)
            else:
                mixed.append(c)
        for c in mixed:
            ids = []
            for w in self.words(c):
                known = cache.get(w)
                if known is None:
                    known = older.get(w) or word(w)
                    if len(w) <= LONG_WORD:
                        cache[w] = known
                ids.append(known)
            cache[c] = b"".join(ids)
        out = [b"".join([cache[c] for c in s]) for s in split]
        for c in new:
            if len(c) > LONG_WORD:
                del cache[c]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Room:
    """Sequences by the tokens they have room for, to find the cheapest one with enough.

    The sequences of equal room are in a heap by cost, so a search looks at the least cost of
    each room from the one asked for on: of the rooms of one row, then of whole rows."""

    NONE = (float("inf"), -1)

    def __init__(self, sequences: int, length: int) -> None:
        self.width = math.isqrt(length) + 1
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width**2)]
        self.heaps[length] = [(0.0, s) for s in range(sequences)]
        self.least = [self.NONE] * self.width**2
        self.rows = [self.NONE] * self.width
        self._note(length)

    def _note(self, room: int) -> None:
        heap = self.heaps[room]
        self.least[room] = heap[0] if heap else self.NONE
        row = room // self.width
        self.rows[row] = min(self.least[row * self.width : (row + 1) * self.width])

    def cheapest(self, room: int) -> tuple[int, int] | None:
        """(room, sequence) of the least cost, ties to the least number, among those with ``room`` or more; it is taken out."""
        row = room // self.width
        ahead = (row + 1) * self.width
        best = min(self.least[room:ahead])
        further = min(self.rows[row + 1 :], default=self.NONE)
        if further < best:
            row = self.rows.index(further, row + 1)
            best, room, ahead = further, row * self.width, (row + 1) * self.width
        if best == self.NONE:
            return None
        at = self.least.index(best, room, ahead)
        heapq.heappop(self.heaps[at])
        self._note(at)
        return at, best[1]

    def put(self, room: int, spent: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (spent, sequence))
            self._note(room)


def assign(lengths: list[int], n_sequences: int, length: int = LENGTH) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pieces (item, start, length) of each sequence, and the pieces left over.

    Items in descending cost go whole to the cheapest of all sequences with room; only where
    none has room for what remains (a sequence's worth at most) is it cut, and the cheapest
    sequence is filled up."""
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(n_sequences)]
    spent = [0.0] * n_sequences
    rooms = Room(n_sequences, length)
    left: list[tuple[int, int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, n = 0, lengths[item]
        while n:
            found = rooms.cheapest(min(n, length)) or rooms.cheapest(1)
            if found is None:
                left.append((item, start, n))
                break
            room, s = found
            part = min(n, room)
            filled[s].append((item, start, part))
            spent[s] += cost(part)
            rooms.put(room - part, spent[s], s)
            start, n = start + part, n - part
    return filled, left


def _emit(items: list[tuple], n_sequences: int, length: int, number: Iterator[int]) -> tuple[dict, list[tuple]]:
    """items: (doc_id, start, ids as bytes, doc_tokens). Rows of the full sequences, and the items left."""
    filled, left = assign([len(i[2]) // 4 for i in items], n_sequences, length)
    rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
    for pieces in filled:
        offset, sequence = 0, next(number)
        for item, start, n in pieces:
            doc_id, before, ids, total = items[item]
            for k, v in zip(rows, (doc_id, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, sequence, offset, None), strict=True):
                rows[k].append(v)
            offset += n
    return rows, [(items[i][0], items[i][1] + s, items[i][2][4 * s : 4 * (s + n)], items[i][3]) for i, s, n in left]


_TYPES = {"ids": pa.binary()}


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES.get(k, pa.int64())) for k, v in rows.items()], names=list(rows))


def _numbers(level: int) -> Iterator[int]:
    """Sequence ids of this task: the level, the partition and a count never meet another's."""
    from pyspark import TaskContext

    k = (level << 58) | (TaskContext.get().partitionId() << 32)
    while True:
        yield k
        k += 1


def _rest_rows(rest: list[tuple]) -> dict:
    """Rows without a sequence, with the ids that still need one."""
    return {
        "doc_id": [r[0] for r in rest], "start": [r[1] for r in rest], "length": [len(r[2]) // 4 for r in rest], "ids_crc32": [0] * len(rest),
        "doc_tokens": [r[3] for r in rest], "sequence_id": [None] * len(rest), "offset": [0] * len(rest), "ids": [r[2] for r in rest],
    }


def _pack_stream(stream: Iterator[tuple], level: int, length: int, last: bool) -> Iterator[pa.RecordBatch]:
    number, held, tokens = _numbers(level), [], 0
    for item in stream:
        held.append(item)
        tokens += len(item[2]) // 4
        if tokens >= BATCH_TOKENS:
            rows, held = _emit(held, tokens // length, length, number)
            tokens = sum(len(i[2]) // 4 for i in held)
            yield _batch(rows)
    if held and tokens >= length:
        rows, held = _emit(held, tokens // length, length, number)
        yield _batch(rows)
    if held and last:
        rows, held = _emit(held, 1, length, number)
        yield _batch(rows)
    if held:
        yield _batch(_rest_rows(held))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)

        def stream() -> Iterator[tuple]:
            for batch in batches:
                for part in split_batch(batch, 1):
                    found = t.encode_batch([x or "" for x in part.column(1).to_pylist()])
                    for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                        yield doc_id, 0, ids + end, len(ids) // 4 + 1

        with no_collection():
            yield from _pack_stream(stream(), 0, length, last=False)

    found = materialize(docs.select("doc_id", "text").mapInArrow(first, PIECES), "packed")
    done = found.where("sequence_id is not null")
    rest = found.where("sequence_id is null")
    level = 1
    while True:
        size = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        groups = -(-size // (FAN_IN * length))
        last = groups <= 4

        def again(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            def stream() -> Iterator[tuple]:
                for b in batches:
                    for r in b.to_pylist():
                        yield r["doc_id"], r["start"], r["ids"], r["doc_tokens"]

            yield from _pack_stream(stream(), level, length, last)

        # the last level is one task: at most 4 * FAN_IN rests of less than a sequence each
        dealt = rest.coalesce(1) if last else rest.repartition(int(groups), F.xxhash64("doc_id", "start"))
        packed = dealt.mapInArrow(again, PIECES)
        if last:
            return done.unionByName(packed).drop("ids")
        packed = materialize(packed, f"rest{level}")
        done = done.unionByName(packed.where("sequence_id is not null"))
        rest = packed.where("sequence_id is null")
        level += 1
