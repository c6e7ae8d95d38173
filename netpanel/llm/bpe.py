"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Let enc(p) be the BPE encoding of the prefix p of a piece. Two adjacent tokens are
compatible if BPE leaves their joined bytes as just these two; an encoding is the one
chain of compatible tokens. So the last token of enc(p) is the one token that ends p and
is compatible with the last token of the encoding before it, and prefixes form a tree.
A state of the transducer is the last token emitted and the bytes since then, with the
tree over them; reading a byte adds a prefix, drops prefixes that no token can reach back
to any more, and emits the tokens that all remaining branches share. States are made when
first reached and kept by (token, bytes), so a text is read by table look-ups; how far
emission lags behind (the lookahead) is bounded by the longest token and a few more.

The decoder turns ids into bytes and bytes into text by an incremental UTF-8 automaton
that carries an unfinished character over to the next chunk.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, no_collection

#: States and pairs of tokens that one worker keeps; at more, a table starts anew.
MAX_STATES, MAX_PAIRS = 150_000, 1_000_000
#: Visits after which a state gets transitions.
VISITS = 6
#: A rank above all others.
NEVER = 1 << 60
#: Pieces whose ids one worker remembers.
CACHE_PIECES = 300_000
#: Bytes that a walk without states reads before it looks again for what all branches share.
HOLD = 64
#: A longer piece is not remembered.
CACHE_LENGTH = 64
#: Ids that one step of the decoder takes.
DECODE_IDS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Node:
    """A node of the trie of all tokens' bytes."""

    __slots__ = ("token", "next")

    def __init__(self) -> None:
        self.token = -1
        self.next: dict[int, Node] = {}


class State:
    """token: the last one emitted (-1 at the start of a piece); pending: bytes since then;
    ends: for each prefix of pending that a live branch passes, its last token and where
    that starts; live: the prefixes after which a token may have begun, with the trie node
    that the bytes since then have reached."""

    __slots__ = ("token", "pending", "ends", "live", "next", "flush", "seen")

    def __init__(self, token: int, pending: bytes, ends: dict[int, tuple[int, int]], live: list[tuple[int, Node]]) -> None:
        self.token, self.pending, self.ends, self.live = token, pending, ends, live
        self.next: dict[int, tuple[tuple[int, ...], State]] = {}
        self.flush: tuple[int, ...] | None = None
        self.seen = 0


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.root = Node()
        for data, rank in ranks.items():
            node = self.root
            for b in data:
                node = node.next.setdefault(b, Node())
            node.token = rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._sound: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.reset()

    def reset(self) -> None:
        """Drops all states. Collection of cycles is off while texts are read (the trie, the
        states and the caches are millions of live objects), so their links are cut here."""
        for s in self.states.values():
            s.next.clear()
        self.states = {}
        self.start = State(-1, b"", {}, [(0, self.root)])
        self.states[-1, b""] = self.start

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition: join the leftmost pair of lowest rank while there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            found = [self.ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int, known: dict[int, tuple]) -> tuple:
        """What stands at one end of the token's bytes while it is merged, from the single
        byte to the whole: (bytes, rank at which it is used up)."""
        found = known.get(token)
        if found is None:
            data = self.bytes_of[token]
            if len(data) == 1:
                found = ((data, NEVER),)
            else:
                inner = self.merge(data, 2)[side]
                *below, (top, _) = self._edge(self.ranks[inner], side, known)
                found = (*below, (top, token), (data, NEVER))
            known[token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (a = -1 at the start of a piece): no merge across the
        border comes before the pieces at the border are used up within a or within b."""
        found = self._fits.get((a, b))
        if found is None:
            sound = self._sound.get(b)
            if sound is None:
                sound = self._sound[b] = self.merge(self.bytes_of[b]) == [self.bytes_of[b]]
            found = sound and (a < 0 or self._border(a, b))
            if len(self._fits) > MAX_PAIRS:
                self._fits.clear()
            self._fits[a, b] = found
        return found

    def _border(self, a: int, b: int) -> bool:
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.ranks.get(x + y, NEVER)
            if across < x_until and across <= y_until and across != NEVER:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """Tokens that are certain once the byte is read, and the state then."""
        n = len(state.pending) + 1
        ends, live, last = state.ends, [], None
        for pos, node in state.live:
            child = node.next.get(byte)
            if child is None:
                continue
            if child.next:
                live.append((pos, child))
            if last is None and child.token >= 0 and self.fits(ends[pos][0] if pos else state.token, child.token):
                last = (child.token, pos)
        if last is not None:
            ends = ends | {n: last}
            live.append((n, self.root))
        emitted: tuple[int, ...] = ()
        token, pending = state.token, state.pending + bytes((byte,))
        sure = self._shared(ends, live) if live and live[0][0] > 0 else 0
        if sure:
            path, pos = [], sure
            while pos > 0:
                at, pos = ends[pos]
                path.append(at)
            emitted = tuple(path[::-1])
            token, pending = emitted[-1], pending[sure:]
            ends, live = self._after(ends, live, sure)
        key = (token, pending)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(token, pending, ends, live)
        known = state.next[byte] = emitted, found
        return known

    def finish(self, state: State) -> tuple[int, ...]:
        if state.flush is None:
            out, i = [], len(state.pending)
            while i > 0:
                token, i = state.ends[i]
                out.append(token)
            state.flush = tuple(out[::-1])
        return state.flush

    def encode(self, piece: bytes) -> list[int]:
        """Follows the states. A state gets transitions once it has been met VISITS times; what
        leaves the beaten track before that is walked without making any states."""
        state, out, at, end = self.start, [], 0, len(piece)
        while at < end:
            known = state.next.get(piece[at])
            if known is None:
                if state.seen < VISITS:
                    state.seen += 1
                    at, state = self._walk(state, piece, at, out)
                    if state is None:
                        return out
                    continue
                if len(self.states) > MAX_STATES:
                    self.reset()  # the state at hand stays whole; its successors are made anew
                    state = State(state.token, state.pending, state.ends, state.live)
                known = self.step(state, piece[at])
            emitted, state = known
            at += 1
            if emitted:
                out += emitted
        out += self.finish(state)
        return out

    def _walk(self, state: State, piece: bytes, at: int, out: list[int]) -> tuple[int, State | None]:
        """Reads on from the state without making states. Tokens go to ``out`` as soon as one
        branch is left, and at the latest when what all branches share must be looked for again
        (HOLD bytes); a state that is already known takes over there. None: the piece is read."""
        ends, live, root, fits, known = state.ends.copy(), state.live, self.root, self.fits, self._fits
        ends[0] = (state.token, 0)
        base, n, look = at - len(state.pending), len(state.pending), HOLD
        for at in range(at, len(piece)):
            byte, n = piece[at], n + 1
            further, last = [], None
            for pos, node in live:
                child = node.next.get(byte)
                if child is not None:
                    if child.next:
                        further.append((pos, child))
                    token = child.token
                    if token >= 0 and last is None:
                        before = ends[pos][0]
                        ok = known.get((before, token))
                        if fits(before, token) if ok is None else ok:
                            last = (token, pos)
            if last is not None:
                ends[n] = last
                further.append((n, root))
            live = further
            if (len(live) == 1 and live[0][0]) or n >= look:
                sure = self._shared(ends, live)
                look = n + HOLD
                if sure:
                    path = []
                    pos = sure
                    while pos > 0:
                        token, pos = ends[pos]
                        path.append(token)
                    out += path[::-1]
                    token = ends[sure][0]
                    ends, live = self._after(ends, live, sure)
                    base, n, look = base + sure, n - sure, HOLD
                    taken = self.states.get((token, piece[base : base + n]))
                    if taken is not None:
                        return at + 1, taken
                    ends[0] = (token, 0)
        path = []
        while n > 0:
            token, n = ends[n]
            path.append(token)
        out += path[::-1]
        return len(piece), None

    @staticmethod
    def _after(ends: dict[int, tuple[int, int]], live: list[tuple[int, Node]], sure: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, Node]]]:
        """ends and live of the branches, counted from the prefix that they share."""
        keep = {}
        for pos, _ in live:
            while pos > sure:
                keep[pos - sure] = (ends[pos][0], ends[pos][1] - sure)
                pos = ends[pos][1]
        return keep, [(pos - sure, node) for pos, node in live]

    @staticmethod
    def _shared(ends: dict[int, tuple[int, int]], live: list[tuple[int, Node]]) -> int:
        """The last prefix (0: none) that all live branches pass."""
        paths = []
        for pos, _ in live:
            path = [pos]
            while pos > 0:
                pos = ends[pos][1]
                path.append(pos)
            paths.append(path[::-1])
        shared = 0
        for at in zip(*paths, strict=False):
            if at.count(at[0]) < len(at):
                break
            shared = at[0]
        return shared


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.fst = Transducer(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.vocabulary = [b""] * (max(self.fst.bytes_of) + 1)
        for i, b in self.fst.bytes_of.items():
            self.vocabulary[i] = b

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        pieces = self.pieces(text)
        if len(self.cache) > CACHE_PIECES:  # what was last used stays at hand for one generation
            self.older, self.cache = self.cache, {}
        cache, older, ranks, long = self.cache, self.older, self.fst.ranks, []
        for p in set(pieces).difference(cache):
            ids = older.get(p)
            if ids is None:
                raw = p.encode()
                whole = ranks.get(raw)
                ids = array("I", (whole,) if whole is not None else self.fst.encode(raw)).tobytes()
                if len(p) > CACHE_LENGTH:
                    long.append(p)
            cache[p] = ids
        out = b"".join(map(cache.__getitem__, pieces))
        for p in long:
            del cache[p]
        return out

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes, chunk by chunk."""
        all_ids = np.frombuffer(ids, "<u4")
        for at in range(0, len(all_ids), DECODE_IDS):
            yield b"".join(map(self.vocabulary.__getitem__, all_ids[at : at + DECODE_IDS].tolist()))


class Utf8Stream:
    """An incremental UTF-8 decoder: state is what an unfinished character still needs.
    Bytes that no character can hold become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(4, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = 0 if last else self.unfinished(data)
        self.held = data[len(data) - cut :] if cut else b""
        return (data[: len(data) - cut] if cut else data).decode("utf-8", "replace")


def decode_text(codec: Codec, ids: bytes) -> str:
    stream = Utf8Stream()
    return "".join([*map(stream.feed, codec.decode(ids)), stream.feed(b"", True)])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every row; a null text is empty."""

    def scan(parts: Iterator) -> Iterator[dict]:
        c = codec(path, pattern)
        with no_collection():
            for doc_ids, texts in parts:
                yield {"doc_id": doc_ids, "ids": [c.encode(t or "") for t in texts]}

    return map_texts(docs, scan, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of encode()'s result; null ids give an empty text."""

    def scan(parts: Iterator) -> Iterator[dict]:
        c = codec(path, pattern)
        for doc_ids, ids in parts:
            yield {"doc_id": doc_ids, "text": [decode_text(c, i or b"") for i in ids]}

    return map_texts(encoded, scan, "doc_id long, text string", ("doc_id", "ids"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, same_text: encodes every whole text,
    then decodes the ids chunk by chunk; digests only leave the task. A null text counts
    as empty (no ids); rows are independent, so repeated rows, ties and null doc_ids
    change nothing; an empty table gives an empty result."""

    def digest(c: Codec, texts: Iterable[str | None]) -> Iterator[tuple]:
        for text in texts:
            ids = c.encode(text or "")
            sha, stream, same, at = hashlib.sha256(), Utf8Stream(), True, 0
            for chunk in c.decode(ids):
                sha.update(chunk)
                part = stream.feed(chunk)
                same &= (text or "").startswith(part, at)
                at += len(part)
            same &= at + len(stream.feed(b"", True)) == len(text or "")
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha.hexdigest(), same

    def scan(parts: Iterator) -> Iterator[dict]:
        c = codec(path, pattern)
        with no_collection():
            for doc_ids, texts in parts:
                n, ids, decoded, same = zip(*digest(c, texts), strict=True)
                yield {"doc_id": doc_ids, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded, "same_text": same}

    return map_texts(docs, scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean")
