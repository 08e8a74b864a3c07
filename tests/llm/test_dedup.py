"""Repeats, suffix arrays, near duplicates and lines against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import _store, line_dedup, minhash, repeats, suffix, suffix_dedup
from lumenlake.llm.graph import components


def brute_repeats(rows, window):
    words = {d: (t or "").encode().split() for d, t in rows}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (6, 3)])
def test_repeats(docs, rows, window, seed):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, window, seed).collect()}
    assert got == brute_repeats(rows, window)


def test_maximal_repeats_are_whole(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"{passage} d")], "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end, r.text) for r in repeats.maximal_repeats(df, 5, 2).collect()} == {(1, 2, 14, passage), (2, 0, 12, passage)}


def brute_bytes(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            s = b[i : i + window]
            if s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed", "many"), [(100, 32, 1024), (24, 8, 1024), (24, 8, 1)])
def test_suffix_dedup(docs, rows, window, seed, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_later(docs, window, seed).collect()}
    assert got == brute_bytes(rows, window)


@pytest.mark.parametrize("window", [35, 200])
def test_long_reaches(spark, window):
    """Windows that reach far beyond their seeds, in passages with and without the same surroundings."""
    rng = random.Random(window)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(window + 60)]
    rows = []
    for d in range(12):
        a, z = rng.randrange(0, 30), rng.randrange(window + 30, window + 60)
        rows.append((d, " ".join([f"a{d}"] * (d % 3) + passage[a:z] + [f"z{d}"] * 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, window, 8).collect()}
    assert got == brute_repeats(rows, window)
    raw = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_later(df, 5 * window, 32).collect()}
    assert raw == brute_bytes(rows, 5 * window)


def test_rows_in_parts(rows, monkeypatch):
    """A long row is looked at in overlapping parts; every window keeps its seed."""
    from lumenlake.llm import _seeds

    text = " ".join(t or "" for _, t in rows).encode() * 2
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    one = np.zeros(1, np.int64)
    seeds = []
    for part in (1 << 21, 1000):
        r = _seeds.find(data, offsets, one, one, 100, 32, part)
        size = r.span + 1
        seeds.append((np.repeat(r.seed, size).tolist(), (np.repeat(r.lo - np.cumsum(size) + size, size) + np.arange(size.sum())).tolist()))
    assert seeds[0] == seeds[1] and seeds[0][1] == list(range(len(text) - 99))


def test_one_id_with_several_texts(spark):
    """Each text is a document of its own; rows that are equal in both are one."""
    long = " ".join(f"w{i}" for i in range(300))
    part, other = " ".join(f"w{i}" for i in range(100, 160)), " ".join(f"v{i}" for i in range(90))
    rows = [(1, long), (1, "short text"), (2, other), (3, f"x {part} y"), (1, other), (1, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(1, 2, 0), (1, 2, 0), (1, 90, 90), (1, 300, 60), (2, 90, 90), (3, 62, 60)]
    later = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_later(df).collect())
    assert later == sorted([(1, len(long), 0), (1, 10, 0), (1, 10, 0), (1, len(other), 0), (2, len(other), len(other)), (3, len(part) + 4, len(part) + 2)])
    lines = spark.createDataFrame([(1, "a b c d e\nf g h i j"), (1, "k l m n o\na b c d e"), (1, "k l m n o\na b c d e")], "doc_id long, text string")
    kept = sorted(r.text for r in line_dedup.dedup_lines(lines).collect())
    assert len(kept) == 3 and kept[0] == "a b c d e\nf g h i j" or kept[0] == "f g h i j"
    assert all("f g h i j" in t or "k l m n o" in t for t in kept) and kept[1] == kept[2]
    assert sum("a b c d e" in t for t in set(kept)) == 1
    assert [r.n_removed for r in line_dedup.summary(lines.limit(0)).collect()] == []


def test_repeated_rows_and_missing_ids(spark):
    long = "x y z " * 50
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None)], "doc_id long, text string")
    for r in repeats.remove_repeats(df.limit(2)).collect():
        assert r.n_removed == 150  # it repeats itself, and rows with one id are one document
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in suffix_dedup.remove_later(df).collect()) == [(False, True), (False, True), (True, False), (True, False)]


def test_empty_tables(empty):
    for f in (repeats.remove_repeats, suffix_dedup.remove_later, minhash.near_duplicates, line_dedup.summary, line_dedup.dedup_lines):
        assert f(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("a", max_size=40).map(str.encode), st.text("abc", min_size=1, max_size=9).map(lambda t: (t * 12).encode())))
def test_suffix_array_and_prefixes(raw):
    text = np.frombuffer(raw, np.uint8)
    sa = suffix.suffix_array(text)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix.permuted_lcp(text, sa)
    for a, b in zip(sa[:-1], sa[1:], strict=True) if len(sa) else ():
        x, y = raw[a:], raw[b:]
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert shared[b] == n


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    """Rows without doc_id, rows that repeat one with the same and another text, clashing names."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, a), (3, a), (3, b), (5, a + " more"), (7, b), (None, a), (None, None), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as rep", "3 as component_id", "4 as h1", "5 as sig")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_a_large_group_keeps_its_links(spark, monkeypatch):
    """Edited copies, many of which are linked by way of others only, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [1, 512])
def test_links_whose_buckets_begin_with_far_documents(spark, block, monkeypatch):
    """Near duplicates, each bucket they share with a smaller document in it that is far from both."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for pair in range(4):
        a = [f"p{pair}w{i}" for i in range(200)]
        b = list(a)
        for k in range(10, 200, 40):
            b[k] = f"e{pair}x{k}"
        texts = [" ".join(w) for w in (a, b)]
        sets = [minhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
        sig = minhash.signatures(sets)
        data = np.frombuffer(texts[0].encode(), np.uint8)
        grams = minhash.ngrams(minhash.hash_spans(data, *minhash.words(data, np.array([0, len(data)]))[:2]), minhash.SHINGLE)
        least = [int(np.argmin((grams ^ minhash._SEEDS[2 * k]) * (minhash._SEEDS[2 * k + 1] | np.uint64(1)))) for k in range(minhash.NUMBERS)]
        for chunk in range(0, minhash.NUMBERS, minhash.CHUNK):
            same = [k for k in range(chunk, chunk + minhash.CHUNK) if sig[0, k] == sig[1, k]]
            for left_out in range(chunk, chunk + minhash.CHUNK):
                four = [k for k in range(chunk, chunk + minhash.CHUNK) if k != left_out]
                if not set(four) <= set(same):
                    continue
                for _ in range(200):
                    decoy = " ".join(f"r{rng.randrange(10**6)} " + " ".join(a[least[k] : least[k] + 5]) for k in four)
                    s = minhash.signatures(minhash.shingle_sets(np.frombuffer(decoy.encode(), np.uint8), np.array([0, len(decoy)])))[0]
                    if (s[four] == sig[0, four]).all() and (s != sig[0]).sum() > minhash.FAR:
                        break
                else:
                    raise AssertionError("no decoy")
                rows.append((len(rows), decoy))
        rows += [(1000 + 2 * pair + k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and [want[1001 + 2 * k][1] for k in range(4)] == [1000 + 2 * k for k in range(4)]


def test_signature_keys_meet_within_the_distance():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    for _ in range(50):
        a = rng.integers(0, 1 << minhash.BITS, minhash.NUMBERS).astype("<u2")
        b = a.copy()
        b[rng.choice(minhash.NUMBERS, 19, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["rep", "sig"])
        keys = defaultdict(set)
        for out in minhash._keys(iter([batch])):
            for k, r in zip(out["key"].to_pylist(), out["rep"].to_pylist(), strict=True):
                keys[k].add(r)
        assert {1, 2} in keys.values()


def test_pairs_within_the_distance_are_all_found(spark):
    """Every pair of signatures that differ in at most 19 numbers and whose sets are similar ends in one component: recall 1."""
    rng = random.Random(13)
    rows = []
    for group in range(25):
        base = [f"g{group}w{i}" for i in range(rng.randint(30, 90))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [minhash.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for _, t in rows]
    sig = minhash.signatures(sets)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    within = similar = 0
    for i in range(len(rows)):
        for k in range(i):
            both = len(np.intersect1d(sets[i], sets[k]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[k]) - both):
                similar += 1
                if (sig[i] != sig[k]).sum() <= 19:
                    within += 1
                    assert got[i] == got[k]
    assert within >= 0.9 * similar > 20
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def brute_lines(rows):
    sets = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = line.encode().split()
            if w:
                sets[d, k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    gone = set()
    places = sorted(sets)
    for i, b in enumerate(places):
        if any(4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for a in places[:i]):
            gone.add(b)
    return gone


def test_lines(docs, rows):
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs).collect()}
    assert got == brute_lines(rows) and got


def test_line_variants(spark):
    """Many near copies of one line: those settled by the first and those that need others."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(40)] = f"e{rng.randrange(20)}"
        rows.append((d, " ".join(w) + f"\nown line of {d} with words {d} {d}"))
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_documents_without_lines_go(spark):
    df = spark.createDataFrame([(1, "a b c d\nx y z"), (2, "a b c d"), (3, None), (4, ""), (5, "a b c d\nmore of it")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str) == [(1, "a b c d\nx y z"), (3, None), (4, ""), (5, "more of it")]


def test_line_dedup_keeps_no_table_that_nothing_reads(spark, docs):
    with _store.scope():
        found = line_dedup.removed_lines(docs)
        left = {path.rsplit("/", 1)[1].rpartition("-")[0] for _, path in _store._open.scopes[-1] if os.path.isdir(path.removeprefix("file://"))}
        assert {"places", "firsts", "marked"} <= left and not left & {"lines", "tokens", "shared", "full", "settled"}
        assert found.count() > 0


def test_lines_in_rounds(spark, docs, rows, monkeypatch):
    """Rounds find what brute force finds, and each leaves nothing but its part."""
    monkeypatch.setattr(line_dedup, "ROUND", 1)
    made = []
    written = _store.in_rounds
    monkeypatch.setattr(_store, "in_rounds", lambda spark, make, rounds, name: made.append((name, rounds)) or written(spark, make, rounds, name))
    with _store.scope():
        got = [(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs.union(docs)).collect()]  # repeated rows
        assert not any("/pairs-" in path and os.path.isdir(path.removeprefix("file://")) for _, path in _store._open.scopes[-1])
    assert set(got) == brute_lines(rows) and len(got) == len(set(got))
    assert made == [("tokens", line_dedup.ROUNDS), ("full", line_dedup.ROUNDS), ("settled", line_dedup.ROUNDS), ("settled", line_dedup.ROUNDS)]


def test_texts_that_lose_no_line_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(f"{rng.random()}" for _ in range(1000)) + ("\nsame line here" if d < 2 else "")) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = _store.written(docs, "docs")

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = line_dedup.dedup_lines(docs)
        began = shuffled()
        assert {r.doc_id: r.text for r in left.collect()} == dict(rows) | {1: rows[1][1].split("\n")[0]}
        assert shuffled() - began < sum(len(t) for _, t in rows) / 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_are_split_and_hashed_once(docs):
    """No filter repeats the hashing of words, which is most of the work."""
    for found in (line_dedup._lines(docs, 1), line_dedup._with_tokens(line_dedup._lines(docs, 1))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" in plan and not any("transform(" in x for x in plan.splitlines() if "Filter" in x)


def test_blank_lines_of_every_kind(spark):
    rows = [(1, " \t\x0b\x0c\r \n\t\n\na b\x0bc\n\xa0"), (2, "\r\n a\tb c\n\x0c\n\x85\n\xa0")]
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) == {(2, 1), (2, 4)}
