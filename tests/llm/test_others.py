"""Packing, archives, language ID, decontamination, media, scores and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import decontaminate, langid, lm_score, mpegts, packing, warc
from lumenlake.llm.queries import tokenizer_path


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=17, max_size=17))
def test_plan_places_every_piece_once(counts):
    counts[0] = 0
    found = packing.plan(np.array(counts), 16)
    placed = Counter()
    for pattern, copies in found:
        assert copies > 0 and sum(n * k for n, k in pattern) <= 16
        for n, k in pattern:
            placed[n] += k * copies
    assert placed == Counter({n: c for n, c in enumerate(counts) if c})
    total, sequences = sum(n * c for n, c in enumerate(counts)), sum(c for _, c in found)
    big = sum(counts[9:])
    assert sequences <= max(math.ceil(total / 16), big) * 11 / 9 + 1


def test_exact_complements_are_used():
    counts = np.zeros(2049, np.int64)
    counts[[2000, 48, 1000, 600, 448]] = [5, 5, 3, 3, 3]
    assert sum(n for _, n in packing.plan(counts, 2048)) == 8


def test_triples_are_searched_to_the_end():
    """Nine lengths whose pair needs them once more come before the one exact triple."""
    counts = np.zeros(2049, np.int64)
    steps = [0, 1, 3, 4, 9, 10, 12, 13, 27]  # none is midway between two others
    counts[[1000, 400, 348, 300, *(500 - k for k in steps), *(48 + 2 * k for k in steps)]] = 1
    assert packing._exact(counts.copy(), 2048, 3)
    left = counts.copy()
    packing._exact(left, 2048, 3)
    assert left[1000] == 0


def _best_fit(counts, capacity):
    """Sequences by plain best fit, a piece at a time."""
    room = []
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else capacity) - length)
    return len(room)


@pytest.mark.parametrize("seed", range(24))
def test_plan_is_never_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([64, 256, 2048]))
    kind = seed % 4
    if kind == 0:
        lengths = rng.integers(1, capacity + 1, 500)
    elif kind == 1:
        lengths = np.clip(rng.lognormal(np.log(capacity / 5), 1, 600).astype(int), 1, capacity)
    elif kind == 2:
        lengths = rng.choice(rng.integers(1, capacity + 1, 9), 400)
    else:
        lengths = rng.integers(capacity // 4, capacity // 2 + 2, 500)
    counts = np.bincount(lengths, minlength=capacity + 1)
    n = sum(k for _, k in packing.plan(counts, capacity))
    bound = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity // 2).sum()))
    assert bound <= n <= _best_fit(counts, capacity)
    if kind == 1:
        assert n <= bound + 2


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    capacity = 64
    got = packing.pack(docs, tokenizer_path(), capacity).toPandas()
    assert sorted(set(got.doc_id)) == sorted(d for d, _ in rows)
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own, at = got[got.doc_id == d].sort_values("piece"), 0
        for k, p in enumerate(own.itertuples()):
            assert p.piece == k and p.start == at and (p.length == capacity or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= capacity


@pytest.mark.parametrize("text", ["a  b", "a \xa0b", "a  \xa0b", "don't x's  it", "\n\n x\n", "naïve 12ab é1", "ab́ c", "<|endoftext|> x", "x\x1cy", "日本 語", "a_b_c (x)", " "])
def test_encoder_equals_the_tokenizer(text):
    e = packing.Encoder(tokenizer_path())
    assert e.encode(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_warc(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "http://b/\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (9, "u", "z" * 200_000)]
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: got[p].refers_to for p in got if got[p].record_type == "revisit"} == {1: 7, 3: 7}


def test_warc_of_odd_pages(spark):
    """Repeated and missing ids, clashing names, no pages at all."""
    big = "z" * 1500
    rows = [(1, big), (1, big), (2, big), (2, big), (None, big), (None, None), (3, "y" * 1200)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as digest", "2 as size", "'x' as headers", "3 as copies")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    assert got == [(0, 0, "response", None), (0, 1500, "revisit", 2), (1, 1500, "revisit", 2), (1, 1500, "revisit", 2), (2, 1500, "response", None), (2, 1500, "response", None), (3, 1200, "response", None)]
    assert warc.archive_round_trip(df.filter("page_id = 99")).collect() == []


def test_warc_appends_and_overwrites(spark, tmp_path):
    warc.register(spark)
    at = str(tmp_path / "archive")
    page = lambda k: spark.createDataFrame([(k, "u", f"page {k}")], "page_id long, url string, html string")
    ids = lambda: sorted(r.headers["x-page-id"] for r in spark.read.format("warc").load(at).collect())
    for k in (1, 2):
        warc.write_pages(page(k), at)
    assert ids() == ["1", "2"]
    spark.createDataFrame([("response", {"X-Page-Id": "3"}, bytearray(b"x"))], "record_type string, headers map<string,string>, block binary").write.format("warc").mode("overwrite").save(at)
    assert ids() == ["3"] and len(list((tmp_path / "archive").iterdir())) == 2


def test_warc_skips_what_is_not_wanted(spark, tmp_path):
    broken = warc.record("response", {"WARC-Target-URI": "http://bad", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip")
    good = warc.record("response", {"WARC-Target-URI": "http://good", "Content-Type": "application/http"}, warc.http_block(b"fine"))
    info = warc.record("warcinfo", {"WARC-Record-ID": "<urn:x>"}, b"software: x")
    (tmp_path / "x.warc").write_bytes(info + broken + good)
    warc.register(spark)
    load = lambda: spark.read.format("warc").load(str(tmp_path))
    assert [bytes(r.payload) for r in load().filter("target_uri = 'http://good'").collect()] == [b"fine"]
    assert load().filter("record_type = 'warcinfo'").first().offset == 0
    assert load().filter("record_type = 'response' and target_uri like '%ood'").count() == 1
    with pytest.raises(Exception, match="(?i)gzip"):
        load().collect()
    assert spark.read.format("warc").option("payload", "false").load(str(tmp_path)).count() == 3


def test_language_id(spark):
    rng = random.Random(2)
    kinds = {"aa": ["the", "and", "thing", "ing"], "bb": ["der", "und", "schön", "über"], "cc": ["que", "où", "é", "tion"]}
    make = lambda k: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(40))
    rows = [(i, make(k), k) for i in range(40) for k in kinds] + [(900, "noise", None), (901, None, "aa"), (902, "", "bb")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, make(k), k) for i in range(20) for k in kinds]
    odd = [(100, None, None), (101, "123 ... !", None), (102, "\n", None), (103, test[0][1], None), (104, test[0][1] * 500, None)]
    got = {(r.doc_id, r.lang): r for r in langid.predict(spark.createDataFrame(test + odd, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i, k].lang_pred == k for i, _, k in test) >= 58
    assert [got[d, None].lang_pred for d in (100, 101, 102)] == ["und"] * 3 and got[100, None].score == 0
    assert got[103, None].lang_pred == got[104, None].lang_pred == got[0, "aa"].lang_pred and got[103, None].score == got[0, "aa"].score
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_samples_distinct_texts(spark):
    """Copies, a text over the limit of bytes, and the languages that have little else."""
    ordinary = [(f"text {i} of aa", "aa") for i in range(30)]
    model = langid.train(spark.createDataFrame(ordinary, "text string, lang string"), 40, 2000)
    copied = langid.train(spark.createDataFrame([r for r in ordinary for _ in range(20)], "text string, lang string"), 40, 2000)
    assert copied.codes.tolist() == model.codes.tolist() and copied.counts.tolist() == model.counts.tolist()
    long = [(f"{i} long text " * 400, "aa") for i in range(12)]
    kept = langid.train(spark.createDataFrame(ordinary + long, "text string, lang string"), 40, 300)
    assert kept.counts.sum() == 300 and set(kept.codes) < set(model.codes)  # the ordinary texts fill it
    few = [("one text of bb", "bb")] * 3000 + [("much longer than may be " * 200, "cc"), ("é" * 500, "dd")]
    assert langid.train(spark.createDataFrame(few + ordinary, "text string, lang string"), 10, 300).langs == ["aa", "bb", "cc", "dd"]


def test_code_lengths_are_those_of_the_counts():
    model = langid.Model(["x"], *np.unique(langid._fours(np.frombuffer(b"abab", np.uint8), np.array([0, 4])), return_counts=True))
    model.counts = model.counts.reshape(-1, 1)
    bits = langid.Scorer(model).bits(np.frombuffer(b"a", np.uint8), np.array([0, 1]))
    # at a text's start the full context is seen once and not kept; one shorter: "a" once of one, one kind
    assert bits[0, 0] == pytest.approx(-math.log2(1 / 2))


def _brute_bits(texts, lang, text):
    """Code lengths a byte at a time, from counts in dictionaries. texts: (text, lang) of the whole sample."""
    seen, every = Counter(), Counter()
    for t, of in texts:
        raw = b"\0\0\0" + t
        for i in range(3, len(raw)):
            every[raw[i - 3 : i]] += 1
            if of == lang:
                for d in range(4):
                    seen[d, raw[i - d : i], raw[i]] += 1
    follow = {}
    for (d, context, byte), n in seen.items():
        follow.setdefault((d, context), {})[byte] = n

    def cost(d, context, byte):
        if d < 0:
            return 8.0
        here = follow.get((d, context[3 - d :]))
        if not here or d == 3 and every[context] < langid.MIN_SEEN:
            return cost(d - 1, context, byte)
        total, kinds = sum(here.values()), len(here)
        return -math.log2(here[byte] / (total + kinds)) if byte in here else -math.log2(kinds / (total + kinds)) + cost(d - 1, context, byte)

    raw = b"\0\0\0" + text
    return sum(cost(3, raw[i - 3 : i], raw[i]) for i in range(3, len(raw)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("abé ", min_size=1, max_size=30), st.sampled_from(["aa", "bb"])), min_size=1, max_size=8), st.lists(st.text("abcé \0", max_size=20), min_size=1, max_size=4))
def test_code_lengths_equal_a_plain_model(sample, texts):
    import pyarrow as pa

    sample = [(t.encode(), k) for t, k in sample]
    langs = sorted({k for _, k in sample})
    tally = Counter()
    for t, k in sample:
        for code in langid._fours(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist():
            tally[code, k] += 1
    codes = sorted({c for c, _ in tally})
    model = langid.Model(langs, np.array(codes, np.uint32), np.array([[tally[c, k] for k in langs] for c in codes], np.int64))
    data, offsets = langid.utf8(pa.array(texts))
    got = langid.Scorer(model).bits(data, offsets)
    want = [[_brute_bits(sample, k, t.encode()) for k in langs] for t in texts]
    assert got == pytest.approx(np.array(want), rel=1e-5, abs=1e-4)


def test_language_id_of_empty_tables_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "abc abd", "x")], "doc_id long, text string, lang string")
    empty = langid.train(rows.filter("false"))
    assert empty.langs == [] and [r.lang_pred for r in langid.predict(rows, empty).collect()] == ["und"]
    model = langid.train(rows)
    assert langid.predict(rows.filter("false"), model).collect() == []
    clash = rows.selectExpr("*", "1 as score", "2 as lang_pred", "3 as n")
    got = langid.predict(clash.union(clash), model).collect()
    assert [(r.lang_pred, r.n) for r in got] == [("x", 3)] * 2 and got[0].score == 1.0
    tie = langid.train(spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string"))
    got = langid.predict(rows, tie).first()
    assert got.lang_pred == "a" and got.score == 0.5  # the first in alphabetical order


def test_language_id_held_out_accuracy(spark):
    from lumenlake.llm.queries import op5_language_id

    got = op5_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def _brute_align(q, t):
    best, h = 0, np.zeros((len(q) + 1, len(t) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(2, 5), min_size=1, max_size=9), st.lists(st.integers(2, 5), min_size=1, max_size=14)), min_size=1, max_size=4))
def test_alignment(pairs):
    q, t = ([np.array(x, np.uint64) for x in side] for side in zip(*pairs, strict=True))
    pad = lambda xs, fill: np.stack([np.append(x, np.full(max(map(len, xs)) - len(x), fill, np.uint64)) for x in xs])
    best, _, _ = decontaminate.align(pad(q, 0), np.array([len(x) for x in q]), pad(t, 1), np.array([len(x) for x in t]))
    assert best.tolist() == [_brute_align(a.tolist(), b.tolist()) for a, b in zip(q, t, strict=True)]


def test_decontamination(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)] + [(9, None), (10, "two words")]
    clean = [(i, " ".join(word() for _ in range(200))) for i in range(30)]
    edited = items[1][1].split()
    for k in range(0, 30, 7):
        edited[k] = "changed"
    leaks = [(100, f"{clean[0][1]} {items[0][1].upper()}, {clean[1][1]}"), (101, " ".join(edited)), (102, f"x {items[2][1]} y {items[3][1]} {items[2][1]}"), (103, items[4][1][:20]), (104, None), (105, "")]
    docs = spark.createDataFrame(clean + leaks, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (102, 3)}
    assert got[100, 0].score == 1 and (got[100, 0].start, got[100, 0].end) == (200, 230) and 0.5 < got[101, 1].score < 1
    blocks = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench, 300).collect()}
    assert blocks == got
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.filter("false")).count() == 0
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in clean} | {103, 104, 105}


def test_seeds_of_common_passages_remain(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(200)], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert got.count() == 200


@pytest.mark.parametrize("hits", [1 << 20, 50])
def test_edited_copies_of_common_items_are_aligned(spark, hits, monkeypatch):
    """Every document with a 3-gram of an item gets the score of a full alignment, however common the item is."""
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(8)
    items = {k: [f"p{k}x{i}" for i in range(n)] for k, n in enumerate((16, 25, 38))}
    docs = {}
    for item in items.values():
        for d in range(150):
            if d < 40:
                edited = item
            elif d < 110:
                edited = [f"e{rng.randrange(10**6)}" if rng.random() < 0.25 else x for x in item]
            else:  # words put in, so that the parts lie on far diagonals
                at = rng.randrange(3, len(item) - 3)
                edited = [*item[:at], *(f"i{rng.randrange(10**6)}" for _ in range(rng.randint(8, len(item) // 2))), *item[at:]]
            docs[len(docs)] = [*(f"a{rng.randrange(10**6)}" for _ in range(9)), *edited, "z"]
    want = {}
    for d, w in docs.items():
        for k, item in items.items():
            grams = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
            if any(tuple(w[i : i + 3]) in grams for i in range(len(w) - 2)) and (best := _brute_align(item, w)) >= min(len(item), 50):
                want[d, k] = best / (2 * len(item))
    found = decontaminate.matches(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == want and len(want) > 300
    without_seeds = sum(_brute_align(item, w) >= min(len(item), 50) for w in docs.values() for item in items.values())
    assert len(want) >= 0.98 * without_seeds  # recall of the seeds against alignments of every document with every item


def test_decontamination_of_odd_tables(spark):
    """Repeated rows, equal items and clashing names."""
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {passage}"), (1, f"x {passage}"), (None, passage), (2, "")], "doc_id long, text string").selectExpr("*", "7 as start", "8 as score", "9 as item_id")
    bench = spark.createDataFrame([(1, passage), (2, passage), (1, passage), (None, passage), (3, None)], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as end")
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.end) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 1, 0, 20), (0, 2, 0, 20), (1, 1, 1, 21), (1, 1, 1, 21), (1, 2, 1, 21), (1, 2, 1, 21)]
    assert [(r.doc_id, r.start) for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [(None, 7), (2, 7)]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_transport_stream_round_trip(raw):
    payload = mpegts.pad(raw)
    media = mpegts.mux(payload)
    u = mpegts.demux(media)
    assert u.payload == payload and u.lost == 0 and len(media) % 188 == 0 and u.ends[-1] == len(payload)
    assert (np.diff(u.pts) > 0).all() and u.random_access[0]


def test_broken_streams_are_seen():
    media = mpegts.mux(mpegts.pad(b"x" * 20_000))
    assert mpegts.demux(media).lost == 0
    with pytest.raises(ValueError):
        mpegts.demux(media[:100])
    bad = bytearray(media)
    bad[188 * 4] = 0
    with pytest.raises(ValueError):
        mpegts.demux(bytes(bad))
    skipped = bytearray(media)
    skipped[188 * 4 + 3] ^= 1
    assert mpegts.demux(bytes(skipped)).lost == 2
    broken = bytearray(media)
    broken[20] ^= 255
    with pytest.raises(ValueError):
        mpegts.demux(bytes(broken))


def test_media_digests(docs, rows, spark):
    got = {r.doc_id: r for r in mpegts.digests(docs).collect()}
    by_text = {}
    for d, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert by_text.setdefault(text or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    few = spark.createDataFrame([(1, "abc" * 2000)], "doc_id long, text string")
    units = mpegts.access_units(mpegts.media_column(few)).orderBy("unit").collect()
    assert b"".join(bytes(u.payload) for u in units) == mpegts.pad(b"abc" * 2000) and units[0].random_access
    whole = mpegts.digests(few).first()
    assert (whole.pts, whole.random_access) == ([u.pts for u in units], [u.random_access for u in units])


def test_scores(docs, rows, empty):
    words = {d: (t or "").encode().split() for d, t in rows}
    one, two = Counter(), Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    total = sum(one.values())
    got = {r.doc_id: r for r in lm_score.scores(docs, 2000, order=2).collect()}
    table = Counter(r.n for r in lm_score.count_table(docs, 2000).collect())
    assert table == Counter([*one.values(), *two.values(), total])
    for d, w in words.items():
        assert got[d].n_words == len(w)
        if not w:
            assert got[d].score is None
            continue
        o1, o2 = Counter(w), Counter(zip(w, w[1:], strict=False))
        left, s = max(1, total - len(w)), 0.0
        for i, x in enumerate(w):
            pair = two[w[i - 1], x] - o2[w[i - 1], x] if i else 0
            alone = (one[x] - o1[x] or 0.4) / left
            s += math.log10(pair / (one[w[i - 1]] - o1[w[i - 1]]) if pair else alone * (0.4 if i else 1))
        assert got[d].score == pytest.approx(s / len(w), abs=2e-6)
    assert lm_score.scores(empty).count() == 0 and mpegts.digests(empty).count() == 0 and packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("order", [1, 3, 5])
def test_scores_of_other_orders(docs, rows, order):
    words = {d: (t or "").encode().split() for d, t in rows}
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    every, total = sum((grams(w) for w in words.values()), Counter()), sum(map(len, words.values()))
    got = {r.doc_id: r.score for r in lm_score.scores(docs, 2000, order=order).collect()}
    for d, w in words.items():
        own = grams(w)
        left = lambda *g: every[g] - own[g]  # noqa: E731,B023

        def score(*g):
            if len(g) == 1:
                return (left(*g) or 0.4) / max(1, total - len(w))  # noqa: B023
            return left(*g) / left(*g[:-1]) if left(*g) else 0.4 * score(*g[1:])  # noqa: B023

        if w:
            assert got[d] == pytest.approx(sum(math.log10(score(*w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) / len(w), abs=2e-6)


def test_pipeline_stages_equal_brute_force(spark, rows, tmp_path):
    """Each stage against a plain version of its rule, on odd rows, copies and a benchmark; and with clashing names."""
    import re

    import corpus_pipeline as c
    from test_dedup import brute_components, brute_lines

    item = [f"q{i}x" for i in range(24)]
    edited = ["changed" if i % 6 == 5 else w for i, w in enumerate(item)]
    now = [*rows, (900, f"before {' '.join(item)}, after"), (902, " ".join(edited)), (904, " ".join(item[:9])), (906, "12 34"), (908, "alone\nalone\nnot alone")]
    bench = [(1, " ".join(item)), (2, None), (3, "two words")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = {k: F.lit("clash") for k in ("n", "rank", "rep", "start", "digest", "__gone", "score", "lang_pred")}
    docs = spark.createDataFrame([(d, t, "xx" if d % 2 else None) for d, t in now] + [(None, None, None)], "doc_id long, text string, lang string").withColumns(more)
    docs = docs.unionByName(docs.filter("doc_id = 904"))  # a row twice
    names = docs.columns

    def stage(k):
        nonlocal docs
        docs = c._store.written(c.STAGES[k][1](spark, docs, str(tmp_path)), "stage")
        return {r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect()

    left = {d: t for d, t in now if any(map(str.isalpha, t or ""))}
    assert stage(0) == left and {r.lang for r in docs.collect()} == {"xx"} and docs.filter("doc_id = 904").count() == 2
    gone, kept = brute_lines(list(left.items())), {}
    for d, t in left.items():
        lines = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
        if len(lines) == len(t.split("\n")) or "".join(lines).encode().split():
            kept[d] = "\n".join(lines)
    assert stage(1) == kept and kept[908] == "alone\nnot alone"
    kept = {d: kept[d] for d, (_, component) in brute_components(list(kept.items())).items() if d == component}
    assert stage(2) == kept
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    query = words(" ".join(item))
    kept = {d: t for d, t in kept.items() if _brute_align(query, words(t)) < 24}
    assert stage(3) == kept and not {900, 902} & set(kept) and docs.columns == names
    packed = stage(4)
    size = Counter(r.doc_id for r in packed if r.piece == 0)
    assert size == Counter({d: 1 + (d == 904) for d in kept})
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= packing.CAPACITY and len(room) <= _best_fit(np.bincount([r.length for r in packed], minlength=packing.CAPACITY + 1), packing.CAPACITY)


def test_pipeline_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars int, component_id string")
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).collect() == [] and stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert c.STAGES[-1][1](spark, docs, str(tmp_path)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(c.STAGES):
        docs = c._store.written(stage(spark, docs, sf), name)
        seen.append(docs.count())
        if k < len(c.STAGES) - 1:
            assert docs.columns == names
            kept = docs
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] >= seen[4] > 0.8 * seen[0] and len(c.STAGES) == 5
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Names with dots, blanks and quotes, and names that operators use inside; and very long texts, which stay as they are."""
    import corpus_pipeline as c

    spark.createDataFrame([(1, " ".join(f"q{i}x" for i in range(24)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(700_000))  # five megabytes
    line = "one two three four five six seven eight"
    rows = [(1, long, "en"), (2, f"{line}\nanother line", None), (3, f"{line}\nthird", "en")]
    names = ["a.b", "x y", "__id", "__of", "__digest", "lang_pred", "__lang_pred", "score", "_again", "gone", "_own", "other_0", "of``it"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names))
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        held = {r["doc_id"]: tuple(r) for r in got.collect()}
        assert got.columns == docs.columns and set(held) == {1, 2, 3} and held[1][1] == long, name
        assert all(r[3:] == tuple(range(len(names))) for r in held.values()), name
        assert held[3][1] == ("third" if name == "line_dedup" else rows[2][1]), name
    assert sum(r.length for r in c.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) > 700_000


def test_a_worker_holds_one_language_model(spark):
    """Not one a task, which stay until Python's garbage is collected: it lives in the worker's own module."""
    rows = spark.createDataFrame([("one two three", "a"), ("vier fünf sechs", "b")] * 20, "text string, lang string").repartition(4)
    model = langid.train(rows)
    assert langid.predict(rows, model).count() == 40

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            home = getattr(sys.modules.get("_lumenlake_worker"), "__dict__", {})
            yield pa.RecordBatch.from_pydict({"key": [str(home.get("language model", ("none",))[0])]})

    assert model.key in {r.key for r in rows.mapInArrow(held, "key string").collect()}
