"""Secrets by pattern and by corpus-wide ownership.

Base spans come from three patterns. Beside them every long token that mixes letters and
digits is a candidate. Values are hashed, and the distinct repositories and owners of
each hash are counted over the corpus. A value that more than MAX_OWNERS owners hold, or
that lies in more repositories than its owners would spread by forks and mirrors
(MAX_REPOS for each owner), is a widely copied example; any other is owner-specific, and
live if it looks random (`liveness`, a score in bits; words of placeholders lower it but
decide nothing alone). The method adds a span of kind `owned` for a candidate outside the
base spans if its value is owner-specific and live and either stands as a credential
elsewhere or is itself long and random.

Defined cases: a null or empty text has no spans; equal rows are scanned one by one and
count once as owners; a null repository or owner counts as one owner; a null doc_id stays;
an empty table gives an empty result; other columns are ignored. A value that is common
to a third of all rows is reduced to one row an owner before it is counted; the counts are
written, so that its join back reads two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts, materialize, split_batch

#: Fixed patterns of the base kinds, in their order, with the group that holds the value
#: and its least length.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (
    (re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 12),
    (re.compile(ACCESS), 0, 18),
    (re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}"), 0, 16),
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}")
#: A value of more owners than this, or of more repositories for each owner, is a copied example.
MAX_OWNERS, MAX_REPOS = 3, 8
#: A live value's least score, and what a word or a run that placeholders have takes from it.
LIVE_BITS, PLACEHOLDER_BITS = 2.5, 1.0
#: A candidate on its own needs this length and this score.
OWN_LENGTH, OWN_BITS = 24, 3.2
PLACEHOLDER = re.compile(r"example|changeme|your|xxxx|placeholder|dummy|sample|(.)\1{5}", re.IGNORECASE)


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def liveness(value: str) -> float:
    """Bits of entropy a character, less where placeholders' words stand; 0 without both letters and digits."""
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return 0.0
    return bits(value) - PLACEHOLDER_BITS * len(PLACEHOLDER.findall(value))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), by start, then kind."""
    out = []
    for kind, (pattern, group, least) in enumerate(BASE):
        out += [(kind, m.start(), m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long mixed tokens outside the base spans."""
    out, limits, at = [], sorted((s, e) for _, s, e, _ in base), 0
    for m in CANDIDATE.finditer(text):
        while at < len(limits) and limits[at][1] <= m.start():
            at += 1
        if at < len(limits) and limits[at][0] < m.end():
            continue
        value = m.group().strip("=.-_/+")
        if len(value) >= 12 and liveness(value) >= LIVE_BITS:
            start = m.start() + m.group().index(value)
            out.append((3, start, start + len(value), value))
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


SCANNED = "doc_id long, text_key long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:int,end:int,value:long,live:boolean,own:boolean>>"


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row a document: counts, digest and all base spans and candidates with hashed values."""

    def run(parts: Iterator) -> Iterator[dict]:
        for ids, keys, repos, owners, texts in parts:
            rows: dict[str, list] = {k.split()[0]: [] for k in SCANNED.split(", ")[:9]}
            for doc_id, t, r, o, text in zip(ids, keys, repos, owners, texts, strict=True):
                base = base_spans(text or "")
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest()
                found = [
                    {"kind": k, "start": s, "end": e, "value": _hash(v), "live": (score := liveness(v)) >= LIVE_BITS, "own": k == 3 and len(v) >= OWN_LENGTH and score >= OWN_BITS}
                    for k, s, e, v in base + candidates(text or "", base)
                ]
                counts = Counter(k for k, *_ in base)
                for key, v in zip(rows, (doc_id, t, r, o, counts[0], counts[1], counts[2], digest, found), strict=True):
                    rows[key].append(v)
            yield rows

    shaped = docs.select("doc_id", F.xxhash64("text").alias("text_key"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), "text")
    return map_texts(shaped, run, SCANNED, ("doc_id", "text_key", "repo", "owner", "text"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, credential: of every hashed value. The first grouping is
    to one row for each value, repository and owner, so that no value is hot in the second."""
    held = found.groupBy("value", "repo", "owner").agg(F.max(F.col("kind") < 3).alias("base"))
    blank = F.lit("\x00")
    return held.groupBy("value").agg(
        F.count_distinct(F.coalesce("repo", blank)).alias("n_repos"),
        F.count_distinct(F.coalesce("owner", blank)).alias("n_owners"),
        F.max("base").alias("credential"),
    )


def find(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_owned, and
    text_key (a hash of the text, so that spans meet their own text if a doc_id repeats).

    repo, owner: columns of docs. By default both are `source`, all that the table knows: then
    each owner has one repository, and max_owners alone decides."""
    repo = F.col("source") if repo is None else repo
    owner = repo if owner is None else owner
    rows = materialize(scan(docs, repo, owner).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.inline("found"))
    counts = materialize(ownership(found), "ownership")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos * F.col("n_owners"))
    owned = (F.col("kind") == 3) & F.col("live") & few & (F.col("credential") | F.col("own"))
    judged = (
        found.join(counts, "value")
        .groupBy("row")
        .agg(
            F.collect_list(F.when(owned, F.struct("start", "kind", "end"))).alias("added"),
            F.count_if((F.col("kind") < 3) & F.col("live") & few).alias("n_live"),
            F.count_if((F.col("kind") < 3) & ~few).alias("n_example"),
        )
    )
    base = F.transform(F.filter("found", lambda s: s.kind < 3), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    names = F.array(*map(F.lit, KINDS))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.array_sort(F.concat(base, F.coalesce("added", none)))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")
    zero = F.lit(0)
    return rows.join(judged, "row", "left").select(
        "doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
        F.when(F.col("added").isNull(), zero).otherwise(F.size("added")).cast("long").alias("n_owned"),
    )


#: What stands in a text for a secret.
MASK = "<SECRET>"


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the union of the spans masked."""
    out, at, open_to = [], 0, -1
    for start, end in sorted(spans):
        if start < open_to:
            open_to = max(open_to, end)
        else:
            if open_to >= 0:
                at = open_to
            out += [text[at:start], MASK]
            open_to = end
        at = open_to
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **how: object) -> DataFrame:
    """All rows and columns of docs, every span of find() masked in the text; n_chars, if
    there is such a column, follows the text. Texts without a span stay as they are; rows
    without a doc_id lose their base spans only."""
    key, more = fresh(docs, "_text_key"), fresh(docs, "_spans")
    found = find(docs, **how).where("n_owned > 0")
    added = found.select("doc_id", F.col("text_key").alias(key), F.col("spans").alias(more)).dropDuplicates(["doc_id", key])
    joined = docs.withColumn(key, F.xxhash64("text")).join(added.hint("merge"), ["doc_id", key], "left").select(*docs.columns, more)
    text_at, spans_at = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, text_at):
                texts = []
                for text, more in zip(part.column(text_at).to_pylist(), part.column(spans_at).to_pylist(), strict=True):
                    found = [(s, e) for _, s, e, _ in base_spans(text or "")]
                    if more:
                        found += [(int(s), int(e)) for _, s, e in (x.split(":") for x in more.split(","))]
                    texts.append(masked(text, found) if found else text)
                columns = {f.name: part.column(i) for i, f in enumerate(part.schema) if i != spans_at}
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    same = zip(texts, part.column(text_at).to_pylist(), columns["n_chars"].to_pylist(), strict=True)
                    columns["n_chars"] = pa.array([n if t == old else len(t) for t, old, n in same], kind)
                columns["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, docs.schema)
