"""Every operator against a brute-force version on the awkward corpus, and on empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions

from netpanel.llm import ann, bpe, exact_dedup, graph, langid, near_dedup, packing, quality, secrets, sharding, substring_dedup

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def judged_copies(rows):
    """Of (doc_id, text): counts of (doc_id, keep_id, group_size, digest), and for each digest the id of the one row that is kept."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    want, kept = Counter(), {}
    for t, ids in groups.items():
        keep, digest = max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest()
        kept[digest] = keep
        for i in ids:
            want[i, keep, len(ids), digest] += 1
    return want, kept


@pytest.mark.parametrize("batches", [2, 3, 5])
def test_exact_dedup(docs, texts, empty, batches):
    got = exact_dedup.dedup(docs, batches=batches).collect()
    want, kept = judged_copies(texts)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted((r.text_sha256, r.doc_id or -1) for r in got if r.kept) == sorted((d, k or -1) for d, k in kept.items())
    assert exact_dedup.dedup(empty, batches=batches).count() == 0


def test_without_copies(docs, texts, empty):
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    _, kept = judged_copies(texts)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").translate(UPPER).encode()).hexdigest()) for r in left.collect()) == Counter((k, d) for d, k in kept.items())
    assert exact_dedup.without_copies(empty).count() == 0


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(i, "same text") for i in range(1, 60)] + [(59, "another text"), (59, "ANOTHER text"), (7, "once more"), (None, "same text"), (None, "once more"), (None, "nobody"), (None, "Nobody"), (7, "same text"), (59, "same text")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: functions.lit(1) for n in ("_id", "_null", "_digest", "_stays", "_n", "digest", "batch", "row", "top")})
    want, kept = judged_copies(rows)
    got = exact_dedup.dedup(d).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(kept))
    left = exact_dedup.without_copies(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id or -1, r.text.lower()) for r in left.collect()) == [(-1, "nobody"), (7, "once more"), (59, "another text"), (59, "same text")]


def test_stored_filters_are_used_again(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i % 70}") for i in range(200)], "doc_id long, text string")
    first = sorted(map(tuple, exact_dedup.dedup(d, store=str(tmp_path)).collect()))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {p.parent.name for p in files} == {"snapshot=0", "snapshot=1"}
    assert [r[:-2] for r in sorted(map(tuple, exact_dedup.dedup(d, store=str(tmp_path)).collect()))] == [r[:-2] for r in first]
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == files


def test_stored_filters_of_another_snapshot_are_not_used(spark, tmp_path):
    def keeps(names):
        d = spark.createDataFrame([(i, f"{n} text {i % 20}") for n in names for i in range(40)], "doc_id long, text string")
        return sum(r.kept for r in exact_dedup.dedup(d, (functions.col("doc_id") >= 20).cast("int"), 2, store=str(tmp_path)).collect())

    assert keeps(["first"]) == 20
    assert keeps(["second"]) == 20  # as many digests, all others
    assert keeps(["first", "second"]) == 40
    assert keeps(["first"]) == 20


@pytest.mark.parametrize("held", [0, 3])
def test_a_small_snapshot_bounds_no_task(spark, held, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 50)
    d = spark.createDataFrame([(i, f"text {i}") for i in range(held)] + [(100 + i, f"text {i}") for i in range(1000)], "doc_id long, text string")
    incoming = functions.col("doc_id") >= 100
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(d, incoming.cast("int"), 2).collect()}
    assert got == {i: (100 + i, False) for i in range(held)} | {100 + i: (100 + i, True) for i in range(1000)}
    later = exact_dedup.digests(d.where(incoming)).withColumn("batch", functions.lit(1))
    screened = exact_dedup.screen(later, exact_dedup.build_filters(exact_dedup.digests(d.where(~incoming)), 1), 1000)
    assert screened.where("maybe").count() >= held and screened.count() == 1000
    groups = later.select(exact_dedup._bucket(20, 17).alias("part")).groupBy("part").count().collect()
    assert len(groups) == 20 and max(r["count"] for r in groups) < 100



def test_binary_fuse_has_no_false_negative():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        f = exact_dedup.BinaryFuse8.from_bytes(exact_dedup.BinaryFuse8.build(keys).to_bytes())
        assert f.might_contain(keys).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert f.might_contain(other).mean() < 0.02
        if n >= 1000:
            assert len(f.cells) < 1.5 * n


def test_sharding(docs, texts, empty):
    got = sharding.shard(docs, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    where = defaultdict(set)
    for r in got:
        where[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in where.values())  # no group here is large enough to be split
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [3000, 40, 0])
def test_placement_is_even_in_all_three_sums(n):
    rng = np.random.default_rng(1)
    v = np.stack([rng.pareto(1.5, n) * 100 + 1, rng.integers(1, 50, n), rng.integers(1, 4, n)], axis=1).round()
    where = sharding.place(v, np.tile(v.sum(axis=0) / 8, (8, 1)))
    for k, slack in enumerate((0.001, 0.01, 0.01)):
        load = np.bincount(where, weights=v[:, k], minlength=8)
        assert load.max() <= max(load.mean() * (1 + slack), (load.mean() if n < 100 else 0) + v[:, k].max(initial=0))


def test_greedy_placement_follows_the_dot_product(monkeypatch):
    monkeypatch.setattr(sharding, "SWAPS", 0)
    monkeypatch.setattr(sharding, "BYTE_SWAPS", 0)
    rng = np.random.default_rng(14)
    v = rng.integers(1, 100, (300, 3)).astype(float)
    where, residual = sharding.place(v, np.tile(v.sum(axis=0) / 4, (4, 1))), np.full((4, 3), 0.25)
    share = v / v.sum(axis=0)
    for i in sorted(range(300), key=lambda i: (-share[i].max(), i)):
        fits = [s for s in range(4) if (residual[s] >= share[i]).all()] or [s for s in range(4) if residual[s, 0] >= share[i, 0]]
        best = max((float(residual[s] @ share[i]) for s in fits), default=None)
        assert best is None or (where[i] in fits and float(residual[where[i]] @ share[i]) >= best - 1e-12)
        residual[where[i]] -= share[i]


@pytest.mark.parametrize("task_groups", [50_000, 90])
def test_shards_are_even_and_big_groups_are_split(spark, monkeypatch, task_groups):
    monkeypatch.setattr(sharding, "TASK_GROUPS", task_groups)
    rows = [(i, "the same text" if i < 400 else "twin" if i < 430 else f"text {'word ' * (i % 7)}{i} {'x' * (i % 90)}") for i in range(1200)]
    docs = spark.createDataFrame(rows + [(None, "the same text")] * 200, "doc_id long, text string")
    got = sharding.shard(docs).toPandas()
    assert len(got) == 1400
    for column, slack in (("size", 0.02), ("tokens", 0.05)):
        load = got.groupby("shard")[column].sum()
        assert len(load) == 8 and load.max() - load.min() <= slack * load.mean() + (60 if task_groups < 100 else 8)
    counts = got["shard"].value_counts()
    assert counts.max() - counts.min() <= 0.1 * counts.mean()
    assert got[got["doc_id"].between(400, 429)]["shard"].nunique() == 1  # a group of less than half a shard
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in texts:
        want[i, tuple([*t.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    got = packing.pack(docs, WORDS).toPandas()
    by_id = defaultdict(list)
    for (i, ids), n in want.items():
        by_id[i] += [ids] * n
    total = sum(len(ids) for v in by_id.values() for ids in v)
    assert got["length"].sum() == total
    for r in got.itertuples():
        crcs = {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in by_id[None if np.isnan(r.doc_id) else int(r.doc_id)] if len(ids) == r.doc_tokens}
        assert r.ids_crc32 in crcs
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-total // 4096) + 1
    assert packing.pack(empty, WORDS).count() == 0


ODD = ["a\x1cb c d don't İstanbul ΣΑΣ ﬁ Å é 12ab_3 <|endoftext|> 'S it's!'s  ", "", "日本語 x\u0085y", "x" * 700 + " y", "½ ² Ⅷ  z",
       "hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "a<|endoftext|>\u0338b <|ENDOFTEXT|> <|endoftext|", "x<|startoftext|> y<|endoftext|>"]


@pytest.mark.parametrize("plain", [False, True])
def test_word_tokenizer_agrees(plain):
    from tokenizers import Tokenizer

    own, theirs = packing.WordTokenizer(WORDS, plain), Tokenizer.from_file(WORDS)
    theirs.encode_special_tokens = plain
    assert own.encode_batch(ODD) == [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch(ODD, add_special_tokens=False)]
    assert own.encode_batch(["hello <|endoftext|> world"])[0] == np.array(theirs.encode("hello <|endoftext|> world", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_tokenizer_refuses_other_files(tmp_path):
    import json

    with open(WORDS) as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not a tokenizer"):
        packing.WordTokenizer(str(tmp_path / "other.json"))


def brute_assign(lengths, n, length):
    """Every sequence is looked at for every piece."""
    room, spent, pieces = [length] * n, [0.0] * n, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            whole = min(left, length)
            able = [s for s in range(n) if room[s] >= whole] or [s for s in range(n) if room[s]]
            if not able:
                break
            s = min(able, key=lambda s: (spent[s], s))
            part = min(left, room[s])
            pieces.append((s, item, start, part))
            room[s], spent[s], start, left = room[s] - part, spent[s] + packing.cost(part), start + part, left - part
    return sorted(pieces)


@pytest.mark.parametrize("length", [4096, 50, 7])
def test_packing_takes_the_cheapest_of_all_sequences(length):
    rng = np.random.default_rng(3)
    lengths = np.maximum(1, rng.lognormal(np.log(length / 6), 1, 1500)).astype(int).tolist()
    n = sum(lengths) // length
    filled, left = packing.assign(lengths, n, length)
    assert sorted((s, i, a, k) for s, seq in enumerate(filled) for i, a, k in seq) == brute_assign(lengths, n, length)
    costs = [sum(packing.cost(k) for *_, k in seq) for seq in filled]
    assert np.std(costs) < 0.35 * np.mean(costs)


def test_packing_covers_each_token_once():
    rng = np.random.default_rng(2)
    lengths = [*rng.integers(1, 900, 200).tolist(), 20_000, 4096, 5000]
    filled, left = packing.assign(lengths, sum(lengths) // 4096)
    seen = {i: np.zeros(n, int) for i, n in enumerate(lengths)}
    for seq in [*filled, left]:
        for i, s, n in seq:
            seen[i][s : s + n] += 1
    assert all((v == 1).all() for v in seen.values())
    assert all(sum(n for *_, n in seq) == 4096 for seq in filled) and sum(n for *_, n in left) < 4096


def test_bpe(docs, texts, empty):
    import tiktoken

    ranks = bpe.read_ranks(BYTES)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in texts:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.round_trip(docs, BYTES, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert got.where("not same_text").count() == 0
    back = bpe.decode(bpe.encode(docs, BYTES, public_tokenizers.PATTERN), BYTES, public_tokenizers.PATTERN)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in texts)
    assert bpe.round_trip(empty, BYTES, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("states", "visits"), [(500, 0), (500, 1), (150_000, 2), (150_000, 10**9)])
def test_transducer_equals_merging(monkeypatch, states, visits):
    monkeypatch.setattr(bpe, "MAX_STATES", states)
    monkeypatch.setattr(bpe, "VISITS", visits)
    monkeypatch.setattr(bpe, "HOLD", 3 if visits == 2 else 64)
    fst = bpe.Transducer(bpe.read_ranks(BYTES))
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.choice(list(b"abehinorst "), n).tolist()) for n in rng.integers(1, 30, 400)]
    pieces += [b"a" * 300, b" " * 99, b"=-" * 80, bytes(range(256))]
    for p in pieces * 3:
        assert fst.encode(p) == [fst.ranks[x] for x in fst.merge(p)]


def test_walks_emit_within_bounded_lookahead():
    """Tokens leave a walk long before the piece ends, also where it never meets a known state."""
    fst = bpe.Transducer(bpe.read_ranks(BYTES))
    piece = bytes(np.random.default_rng(5).choice(list(b"abehinorst"), 5000).tolist())
    out, held = [], []

    class Bytes(bytes):
        def __getitem__(self, at):
            if isinstance(at, int):
                held.append(at - sum(len(fst.bytes_of[t]) for t in out))
            return super().__getitem__(at)

    at, state = fst._walk(fst.start, Bytes(piece), 0, out)
    assert (at, state) == (len(piece), None) and out == [fst.ranks[x] for x in fst.merge(piece)]
    assert max(held) < 2 * max(map(len, fst.ranks))


def test_utf8_stream():
    text = "aé日🙂" * 5
    raw = text.encode()
    for step in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        assert "".join([*(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)), s.feed(b"", True)]) == text
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xff") + s.feed(b"\xe6\x97") + s.feed(b"", True) == "a��"


def base_spans(text):
    out = []
    for k, (name, p, g, least) in enumerate((
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    )):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [f"{n}:{s}:{e}" for s, _, n, e in sorted(out)]


def test_secrets(docs, texts, empty):
    got = secrets.find(docs).collect()
    want = Counter((i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in texts)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert (kinds["assign"], kinds["access"], kinds["hex"], kinds["owned"]) == (r.n_assign, r.n_access, r.n_hex, r.n_owned)
    bare = next(i for i, t in texts if t == "see hunter2hunter2x9 again")
    assert [r.spans for r in got if r.doc_id == bare] == ["owned:4:20"]
    assert secrets.find(empty).count() == 0


def test_copied_examples_are_not_owned(spark):
    value = "Zx81kQp02LmN7vB3"
    rows = [(i, f"password={value}", f"repo{i}") for i in range(9)] + [(90, f"mentions {value} bare", "repo1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.find(docs).collect()}
    assert got[90].n_owned == 0 and got[0].n_example == 1 and got[0].n_live == 0
    few = {r.doc_id: r for r in secrets.find(docs.where("doc_id in (1, 90)")).collect()}
    assert few[90].n_owned == 1 and few[1].n_live == 1


def test_repositories_and_owners_both_count(spark):
    """By brute force over the stated rule: few owners, and few repositories for each of them."""
    rng = np.random.default_rng(21)
    alphabet = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789")
    values = ["".join(rng.choice(alphabet, n)) + "7z" for n in rng.integers(12, 40, 24)] + ["yourExample12z34q5678wr90tuv", "exampleExampleexample12"]
    rows, k = [], 0
    for v in values:
        owners, repos = int(rng.integers(1, 7)), int(rng.integers(1, 15))
        for o in range(owners):
            for r in range(repos):
                rows.append((k, f"password={v}" if (r + o) % 3 == 0 else f"mentions {v} here", f"repo{v[:4]}{o}x{r}", f"owner{o}"))
                k += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = {r.doc_id: r for r in secrets.find(d, functions.col("repo"), functions.col("owner")).collect()}
    for i, text, _, _ in rows:
        v = re.sub("password=|mentions | here", "", text)
        mine = [x for x in rows if v in x[1]]
        few = len({x[3] for x in mine}) <= secrets.MAX_OWNERS and len({x[2] for x in mine}) <= secrets.MAX_REPOS * len({x[3] for x in mine})
        live = secrets.liveness(v) >= 2.5
        if text.startswith("mentions"):
            assert got[i].spans == (f"owned:9:{9 + len(v)}" if few and live else "")
        else:
            assert (got[i].n_live, got[i].n_example) == (int(few and live), int(not few))
    assert any(r.n_owned for r in got.values()) and any(r.n_example for r in got.values())


def test_redact_leaves_clashing_columns(spark):
    rows = [(1, "password=hunter2hunter2x9", "a"), (2, "see hunter2hunter2x9", "a"), (2, "see nothing", None)]
    names = ("__masked_key", "__masked_spans", "_text_key", "_spans", "spans", "text_key", "value", "row", "found")
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: functions.lit(n) for n in names})
    out = secrets.redact(d)
    assert out.columns == d.columns
    got = sorted(out.collect())
    assert [r.text for r in got] == ["<SECRET>", "see <SECRET>", "see nothing"] and all(r[n] == n for r in got for n in names)


def test_redact(docs, texts, empty):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for i, t in texts:
        if i is not None and not base_spans(t or "") and "hunter2" not in (t or ""):
            assert by_id[i].text == t
    assert not any("hunter2hunter2x9" in (r.text or "") for r in by_id.values())
    assert secrets.redact(empty).count() == 0
    assert secrets.masked("abcdefgh", [(1, 3), (2, 5), (5, 6)]) == "a<SECRET><SECRET>gh"


def brute_near(texts, threshold=85):
    sets, out = [], {}
    for i, t in texts:
        w = words((t or "").translate(UPPER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= threshold * len(s | t):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    for i, s in sets:
        if i is not None:
            out[i] = (len(s), top(i))
    return out


@pytest.mark.parametrize("threshold", [85, 80])
def test_near_dedup(docs, texts, empty, threshold):
    got = near_dedup.near_dedup(docs, threshold)
    assert got.count() == len(texts)
    want = brute_near(texts, threshold)
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_dedup(empty, threshold).count() == 0
    kept = near_dedup.without_near_copies(docs, threshold)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in want.items() if i == c}


def test_near_dedup_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PARTNERS", 16)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 5)):
            w[k] = f"z{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: c for i, (_, c) in brute_near(rows).items()}


def test_near_dedup_of_a_template_makes_no_pairs(spark, monkeypatch):
    """10,000 texts of one template, any two at resemblance 0.8, fill buckets that no leader settles;
    only those that are planted as copies are linked, and few pairs are ever made."""
    made = []
    confirm = near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, texts, t: made.append(pairs.count()) or confirm(pairs, texts, t))
    n = 10_000
    template = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*template, *(f"v{i}x{k}" for k in range(9))])) for i in range(n)]
    rows += [(n + i, rows[100 * i][1].rsplit(" ", 1)[0] + " last") for i in range(20)]
    x, y = near_dedup.shingle_sets([rows[0][1], rows[1][1]])
    assert 0.79 < len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < 0.85
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: i if i < n else 100 * (i - n) for i, _ in rows}
    assert sum(made[1:]) < 1000


def test_near_dedup_of_two_large_families_with_links_between(spark):
    rng = np.random.default_rng(16)
    rows = []
    for family in range(3):
        base = [f"w{k}" for k in range(70)] + [f"f{family}x{k}" for k in range(12)]
        for _ in range(60):
            w = list(base)
            for k in rng.integers(0, 82, rng.integers(0, 4)):
                w[k] = f"z{len(rows)}x{k}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join([*(f"w{k}" for k in range(70)), *(f"f{i % 3}x{k}" for k in range(12 - i)), *(f"f{(i + 1) % 3}x{k}" for k in range(i))])) for i in range(12)]
    for t in (85, 80):
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), t).collect()}
        assert got == {i: c for i, (_, c) in brute_near(rows, t).items()}


def test_prefixes_meet_for_all_similar_sets():
    rng = np.random.default_rng(17)
    for t in (80, 85, 95):
        for _ in range(300):
            pool = np.unique(rng.integers(0, 2**62, 80)).astype(np.uint64)
            n = int(rng.integers(1, 60))
            x = np.sort(rng.choice(pool[:70], n, replace=False))
            y = np.unique(np.concatenate([x[rng.random(n) < 0.95], rng.choice(pool, 1 + n // 12)]))
            if not near_dedup.linked(x, y, t):
                continue
            x, y = sorted((x, y), key=len)
            keep = len(y) - -(-t * len(y) // 100) + 1
            short = len(x) - -(-2 * t * len(x) // (100 + t)) + 1
            assert set(x[:short]) & set(y[:keep])


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    pairs = [(np.sort(pool[a : a + 400]), np.sort(pool[a + 50 : a + 450])) for a in range(0, 2500, 50)]
    est = []
    for s, t in pairs:
        a, b = near_dedup.signatures([s, t])
        est.append((a == b).mean())
    assert abs(np.mean(est) - 350 / 450) < 0.02


def brute_substring(texts):
    seen, gone, all_words = {}, {}, {}
    rows = sorted(((i, t) for i, t in texts if i is not None), key=lambda r: r[0])
    for i, t in rows:
        all_words[i] = words(t)
        gone.setdefault(i, set())
        for k in range(len(all_words[i]) - 19):
            first = seen.setdefault(tuple(all_words[i][k : k + 20]), (i, k))
            if first < (i, k):
                gone[i] |= set(range(k, k + 20))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in all_words.items()}


@pytest.mark.parametrize("buckets", [None, 7])
def test_substring_dedup(docs, texts, empty, buckets):
    got = substring_dedup.remove(docs, buckets).collect()
    assert len(got) == len(texts)
    want = brute_substring(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    nulls = sorted(((r.n_words, r.n_removed) for r in got if r.doc_id is None))
    assert nulls == [(0, 0), (4, 0), (120, 120)]  # a null id comes after all others
    assert substring_dedup.remove(empty).count() == 0


def test_substring_dedup_within_and_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", 4000)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 3, rng.integers(5, 200)))) for i in range(120)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 5).collect()}
    assert got == brute_substring(rows)


def test_langid(spark, docs, empty):
    rng = np.random.default_rng(9)
    parts = {"aa": ["la", "mo", "ne", "ri"], "bb": ["schtz", "werk", "ung", "kei"], "cc": ["ção", "ñor", "aqu", "llo"]}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))

    rows = [(i, text(lang), lang) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, text("aa", 80) + " " + text("bb", 30), None), (901, None, "aa"), (902, "12 ?!", "aa"), (903, "", "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == ("aa", "bb", "cc")[i % 3] for i in held]) > 0.98
    assert set(got[900].langs) == {"aa", "bb"} and abs(got[900].shares[0] - 80 / 110) < 0.1
    assert [got[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = langid.identify(docs)
    assert odd.count() == docs.count() and odd.where("score < 0 or score > 1").count() == 0
    assert langid.known_only(docs).columns == docs.columns
    assert langid.known_only(d).where("doc_id >= 901").count() == 0
    assert langid.identify(empty).count() == 0 and langid.known_only(empty).count() == 0
    nothing = langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("1 = 1").replace("", None, ["lang"]))
    assert nothing.where("lang_pred <> 'und'").count() == 0


def one_frequent_gram(n, seed=15):
    """Texts that repeat the gram of least hash, so that it is nearly every window's minimiser."""
    rng = np.random.default_rng(seed)
    grams = [f"g{k} h{k} i{k}" for k in range(400)]
    least = [int(substring_dedup.rolling(substring_dedup.Words([g]).hashes(), 3)[0]) for g in grams]
    gram = grams[int(np.argmin(least))]
    texts = [" ".join(f"{gram} " + " ".join(f"w{x}" for x in rng.integers(0, 9, 9)) for _ in range(int(rng.integers(2, 12)))) for _ in range(n)]
    texts += texts[:5] + [" ".join(t.split()[3:]) for t in texts[5:9]]
    return list(enumerate(texts))


def test_a_frequent_minimiser_is_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LIMIT", 300)
    rows = one_frequent_gram(150)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(d, 40).collect()}
    assert got == brute_substring(rows)
    raw = [t.encode() for _, t in rows]
    counts = substring_dedup.Counts()
    counts.add(raw)
    codes, n = counts.above(1)
    total, windows = sum(map(len, raw)), int(n.sum())
    assert n.max() > windows / 2
    hot = substring_dedup.overfull(d, total, 300)
    assert set(codes[n >= 300]) <= set(hot) <= set(codes[n >= 150])

    def largest(hot):
        packer = substring_dedup.Packer(40, hot)
        packer.add(np.arange(len(raw)), np.zeros(len(raw), np.int64), raw)
        parts = packer.parts[0]
        return np.bincount(parts[0], parts[2]["n"] - 19, 40).max() / windows

    assert largest(None) > 0.5 and largest(hot) < 0.1


def plain_mixture(model, text):
    """Expectation-maximisation and the penalised choice of languages for one text, word by word."""
    import math
    import unicodedata

    found, word = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if (kind == "L" or (kind == "M" and word)) and len(word) < langid.WORD_LENGTH:
            word += c
        else:
            found += [word] if word else []
            word = c if kind == "L" else ""
    if not found:
        return "und", 0.0, {}
    like = []
    for w in found:
        cells, _ = langid.trigrams([w])
        assert len(cells) == len(w)
        like.append([sum(float(model.logp[c, k]) for c in cells) for k in range(len(model.langs))])
    pi = [1 / len(model.langs)] * len(model.langs)
    for _ in range(langid.ITERATIONS):
        share = [0.0] * len(pi)
        for row in like:
            top = max(row)
            part = [p * math.exp(x - top) for p, x in zip(pi, row, strict=True)]
            for k, v in enumerate(part):
                share[k] += v / sum(part)
        pi = [v / len(found) for v in share]
    order = sorted(range(len(pi)), key=lambda k: -pi[k])
    alone = [sum(row[k] for row in like) for k in range(len(pi))]
    best, chosen = max(alone), [alone.index(max(alone))]
    for k in range(2, len(pi) + 1):
        part = [pi[c] / sum(pi[c] for c in order[:k]) for c in order[:k]]
        got = sum(max(row) + math.log(max(sum(p * math.exp(row[c] - max(row)) for p, c in zip(part, order[:k], strict=True)), 1e-30)) for row in like)
        got -= langid.PENALTY * (k - 1) * math.log(len(found) + 1)
        if got > best:
            best, chosen = got, order[:k]
    return model.langs[chosen[0]], pi[chosen[0]], {model.langs[c]: pi[c] / sum(pi[c] for c in chosen) for c in chosen}


def test_langid_equals_plain_expectation_maximisation(spark):
    rng = np.random.default_rng(19)
    parts = {"aa": ["la", "mo", "né", "ri"], "bb": ["schtz", "werk", "ung", "kei"], "cc": ["ção", "ñor", "aqu", "llo"], "hi": ["नम", "स्ते", "है"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))

    d = spark.createDataFrame([(text(lang, 40), lang) for lang in parts for _ in range(8)], "text string, lang string")
    model = langid.fit(d)
    mixed = [text("aa", 30) + " " + text("bb", k) for k in range(0, 40, 7)] + [text("cc", 3), text("hi", 5), "½ ²", "Ⅷ ① 12", "लि ½ la", "x" * 300]
    for t, got in zip(mixed, langid.Mixture(model).infer(mixed), strict=True):
        lang, score, shares = plain_mixture(model, t)
        assert got[0] == lang and set(got[2]) == set(shares)
        assert abs(got[1] - score) < 1e-3 and all(abs(shares[k] - v) < 1e-3 for k, v in zip(got[2], got[3], strict=True))
    assert [g[0] for g in langid.Mixture(model).infer(["½ ²", "Ⅷ ①", None, "۱۲"])] == ["und"] * 4


def test_noise_is_rejected_and_languages_stay(spark):
    rng = np.random.default_rng(20)
    vocabulary = ["".join(rng.choice(list("etaoin"), rng.integers(2, 8))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)), "en") for i in range(90)]
    junk = [(1000 + i, " ".join("".join(rng.choice(list("qxzjkvwß"), 9)) for _ in range(20)), None) for i in range(10)]
    d = spark.createDataFrame(rows + junk + [(2000, vocabulary[0], None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.known_only(d).collect()) == [*range(90), 2000]


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(400):
        n = int(rng.integers(20, 120))
        w = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n)]
        if i % 4 == 0:
            w = [f"{x.upper()}!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 != 0), 0))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).toPandas().sort_values("doc_id")
    held = got[got["held_out"]]
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held["predicted"] == (held["doc_id"] % 4 != 0)).mean() > 0.95
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    again = quality.classify(d.repartition(7), lab.repartition(3)).toPandas().sort_values("doc_id")
    assert np.allclose(got["score"], again["score"])
    odd = quality.classify(docs, lab.unionByName(spark.createDataFrame([(None, None, None), (3, None, 1)], lab.schema)))
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(docs, lab.where("1 = 0")).where("score <> 0.5").count() == 0
    assert quality.classify(empty, lab).count() == 0


def test_dual_descent_lowers_the_objective():
    rng = np.random.default_rng(11)
    rows = [np.unique(rng.integers(0, 500, 30)).astype(np.uint32) for _ in range(200)]
    y = np.array([int((r < 60).sum() > 3) for r in rows])
    ratio = quality.log_count_ratios(rows, y)

    def objective(w):
        m = np.array([(w[:-1][x] * ratio[x]).sum() / np.sqrt(len(x)) for x in rows]) + w[-1]
        return 0.5 * w @ w + quality.COST * np.maximum(0, 1 - np.where(y > 0, 1, -1) * m).sum()

    values = [objective(quality.descend(rows, y, ratio, epochs=e)) for e in (1, 5, 40)]
    assert values[2] <= values[1] * 1.01 and values[2] < objective(np.zeros(quality.DIMENSIONS + 1))


def plain_classifier(texts, y):
    """Log-count ratios and dual coordinate descent on dictionaries, one indicator at a time; the
    bias is an indicator that all texts have. Weights by indicator, and the bias."""
    docs = [set(x.tolist()) for x in quality.indicators(texts)]
    count = [defaultdict(lambda: quality.ALPHA), defaultdict(lambda: quality.ALPHA)]
    for x, label in zip(docs, y, strict=True):
        for g in x:
            count[label][g] += 1
    total = [sum(c.values()) + quality.ALPHA * (quality.DIMENSIONS - len(c)) for c in count]
    names = set().union(*docs)
    ratio = {g: np.log(count[1].get(g, quality.ALPHA) / total[1]) - np.log(count[0].get(g, quality.ALPHA) / total[0]) for g in names}
    w, bias, alpha = dict.fromkeys(names, 0.0), 0.0, [0.0] * len(docs)
    rng = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(docs)).tolist():
            sign, scale = (1 if y[i] else -1), 1 / np.sqrt(len(docs[i]))
            margin = sum(w[g] * ratio[g] * scale for g in docs[i]) + bias
            curve = sum((ratio[g] * scale) ** 2 for g in docs[i]) + 1
            new = min(max(alpha[i] - (sign * margin - 1) / curve, 0.0), quality.COST)
            for g in docs[i]:
                w[g] += (new - alpha[i]) * sign * ratio[g] * scale
            bias += (new - alpha[i]) * sign
            alpha[i] = new
    return {g: w[g] * ratio[g] for g in names}, bias, docs


def test_classifier_equals_plain_naive_bayes_support_vectors():
    rng = np.random.default_rng(18)
    texts = [" ".join("".join(rng.choice(list("abcdef" if i % 3 else "efghij"), 3)) for _ in range(25)) for i in range(60)]
    y = [int(i % 3 > 0) for i in range(60)]
    weights, bias, docs = plain_classifier(texts, y)
    rows = quality.indicators(texts)
    ratio = quality.log_count_ratios(rows, np.array(y))
    w = quality.descend(rows, np.array(y), ratio)
    got = quality.margins(rows, np.append(ratio * w[:-1], w[-1]))
    want = [sum(weights[g] for g in d) / np.sqrt(len(d)) + bias for d in docs]
    assert np.allclose(got, want, atol=1e-8) and got[np.array(y) == 1].min() > got[np.array(y) == 0].max()


def test_the_sample_is_bounded_by_indicators(spark):
    rng = np.random.default_rng(22)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(20000 if i == 7 else 30))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    whole, few = quality.fit(d, lab), quality.fit(d, lab, indicators_bound=3000)
    assert not np.allclose(whole, few) and np.allclose(few, quality.fit(d.repartition(5), lab, indicators_bound=3000))


def brute_nearest(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    dims = Counter(len(v) for _, v in good)
    dim = max(dims, key=lambda d: (dims[d], d))
    good = [(i, v) for i, v in good if len(v) == dim]
    out = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(v, x, strict=True)), i) for i, v in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_rows_that_repeat_a_query_id(spark):
    rng = np.random.default_rng(23)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 60)]
    rows += [(20, rows[19][1]), (40, rng.standard_normal(8).tolist())]  # an exact repeat, and another vector
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    want = []
    for q, x in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted((-float(np.dot(v, x)), i) for i, v in rows if i != q)[:20], 1)]
    assert len(got) == 60
    assert sorted((q, r, i, round(s, 9)) for q, r, i, s in got.itertuples(index=False)) == sorted((q, r, i, round(s, 9)) for q, r, i, s in want)


@pytest.mark.parametrize("blocks", [(65_536, 512), (100, 7)])
def test_nearest(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "CANDIDATES", blocks[0])
    monkeypatch.setattr(ann, "QUERIES", blocks[1])
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[40][1]) for i in range(600, 680)]  # a very common vector
    rows += [(820, [float("inf")] * 24), (840, [1.0] * 23 + [float("-inf")]), (700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [None] * 24), (780, [1.0] * 23), (None, [1.0] * 24), (800, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    d = d.withColumns({n: functions.lit(1) for n in ("v", "part", "block", "code", "raw", "packed", "query", "score", "rank", "query_id")})
    got = sorted(tuple(r) for r in ann.nearest(d).collect())
    want = brute_nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert ann.nearest(d.where("vec_id in (20, 21, 22)")).count() == 2
    assert ann.nearest(d.where("1 = 0")).count() == 0
