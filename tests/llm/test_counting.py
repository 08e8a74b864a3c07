"""Token counts, divergence of sources and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import divergence, importance, token_counts
from lumenlake.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _odd(rng, n):
    """Texts of what tokenizers cut in odd ways."""
    parts = ["a", "B", "é", "ß", "日", "1", "9", "½", "'", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "　", "​", "\x1c", "\x00", "\x7f", ".", "!", "'s", "don't", "<|endoftext|>", "word", "́", "\r\n", "😀", "_", " the", " of", "²"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def _library_counts(texts, name="byte_bpe_50k.json"):
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        return [len(pieces.encode(t, num_threads=1)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_units_are_counted_as_the_library_counts_texts():
    rng = random.Random(8)
    texts = [*_odd(rng, 20000), "", None, " ", "\n\n"]
    found, _ = token_counts._counted(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    units, count = token_counts._bytes_of(found), token_counts._library(tokenizer_path())
    half = np.arange(0, len(units), 2)  # of the units every other is in the table
    table = token_counts.Table(*(found[c].to_numpy()[half] for c in ("low", "high")), found["size"].to_numpy()[half].astype(np.int64), np.array([count(units[i].decode()) for i in half]))
    counter = token_counts.Counter(tokenizer_path(), token_counts.Table.of(table.arrays()))
    assert counter.counts(pa.array(texts)).tolist() == _library_counts([t or "" for t in texts])


def test_table_holds_exact_bytes():
    rng = random.Random(3)
    keys = sorted({(rng.getrandbits(64), rng.getrandbits(64) if n > 8 else 0, n) for n in range(1, 17) for _ in range(200)})
    low, high, size = (np.array(c, t) for c, t in zip(zip(*keys, strict=True), (np.uint64, np.uint64, np.int64), strict=True))
    table = token_counts.Table(low, high, size, size)
    assert table.find(low, high, size).tolist() == size.tolist()
    assert not table.find(low, high ^ np.uint64(1), size).any() and not table.find(low, high, size % 16 + 1).any()
    assert not token_counts.Table(*(x[:0] for x in (low, high, size, size))).find(low, high, size).any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, rows, docs, name):
    rng = random.Random(5)
    more = [(1000 + i, t) for i, t in enumerate(_odd(rng, 60))] + [(5000, "ab cd " * 900_000), (5001, "x" * 200_000), (7, "same"), (7, "same")]
    every = [*rows, *more]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").repartition(4)).withColumns({c: F.lit(1) for c in ("n_tokens", "low", "total", "summary")})
    if name.endswith(".model"):  # one very long text is enough of that library
        df, every = df.filter("doc_id != 5000"), [r for r in every if r[0] != 5000]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, tokenizer_path(name), most=50).collect())
    n = _library_counts([t or "" for _, t in every], name)
    assert got == Counter((d, len((t or "").encode()), k, k > 1024) for (d, t), k in zip(every, n, strict=True))


def test_frequent_pretokens_are_found_over_all_tasks(spark):
    df = spark.createDataFrame([(f"often rare{i} often",) for i in range(400)], "text string").repartition(9)
    held = token_counts.frequent(df, 100)
    found = dict(zip(token_counts._bytes_of(held), held["n"].to_pylist(), strict=True))
    assert found[b" often"] == 400 and found[b"often"] == 400 and held.num_rows <= 100


def test_token_counts_of_nothing(spark, empty):
    assert token_counts.token_counts(empty, tokenizer_path()).count() == 0
    none = spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(none, tokenizer_path()).collect()), key=str) == [(1, 0, 0), (None, 1, 1)]


def _audit(rows, min_docs=3, top=200):
    """rows: text, lang, source."""
    split = [([*re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))], lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in split}:
        mine = [x for x in split if x[1] == lang]
        kept = sorted(t for t, n in Counter(t for w, _, _ in mine for t in set(w)).items() if n >= min_docs)
        every = Counter(t for w, _, _ in mine for t in w)
        whole = sum(every[t] for t in kept)
        q = {t: 1 + 10**9 * (every[t] + 1) // (whole + len(kept)) for t in kept}
        counts = {s: Counter(t for w, _, z in mine if z == s for t in w) for s in {x[2] for x in mine}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts:
            pair = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            term = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part in (pair, term):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, s, *x, i + 1) for part in (pair, term[:top]) for i, x in enumerate(part)]
    return Counter(out)


def _labelled(rng, n, sources=5):
    words = ["ab", "Cd", "ÉF", "éf", "x1y", "z", "日本", "qu", "ri", "so", "tu", "v" * 40]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words[: 4 + i % 9]) + rng.choice(["", ",", "7", "\n"]) for _ in range(rng.randrange(40)))
        out.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice([*(f"s{k}" for k in range(sources)), None, ""])))
    return [*out, *out[:20], ("ab " * 700_000, "en", "s0"), ("only", "fr", "one"), ("12 34", "xx", "none"), ("12 34", "xx", "other")]


def _audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "number", "block", "rank", "value", "doc_id")})
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **more).collect())


def test_divergence(spark):
    rows = _labelled(random.Random(2), 120)
    assert _audited(spark, rows) == _audit(rows)
    assert _audited(spark, rows, top=3, min_docs=1) == _audit(rows, 1, 3)


def test_divergence_in_small_tiles(spark, monkeypatch):
    """Many blocks, many tiles of terms and of sources, and tasks that send on what they hold at once."""
    for name, value in (("SOURCES", 3), ("TILE", 8), ("BLOCK_ROWS", 7), ("HELD", 5)):
        monkeypatch.setattr(divergence, name, value)
    rows = _labelled(random.Random(4), 90, 9)
    assert _audited(spark, rows) == _audit(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    assert _audited(spark, [("a", "en", "x"), (None, "en", "y")]) == {("en", "x", "pair", "y", 0, 1): 1, ("en", "y", "pair", "x", 0, 1): 1}


def test_shares_do_not_leave_64_bits():
    n = np.array([0, 1, 7 * 10**14, 10**15 - 1, 10**15], np.int64)
    assert divergence._share(n, 10**15).tolist() == [1 + 10**9 * int(x) // 10**15 for x in n]


def _resample(rows, target, percent=5, min_words=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own = [Counter(map(bucket, grams(split(t)))) for _, t in rows]
    s, t = sum(own, Counter()), Counter(b for x in target for b in map(bucket, grams(split(x))))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for (doc, text), c in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in c.items())
        out.append([doc, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text))])
    eligible = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0], x[1], x[2]))
    for i, x in enumerate(eligible[: percent * len(eligible) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in out)


def test_resampling(spark, rows, docs):
    more = [(2000, "Ab cd. " * 400_000), (2001, "é1 É2 " * 30), (7000, "same words here " * 9), (7000, "same words here " * 9)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(6).withColumns({c: F.lit("clash") for c in ("n_words", "buckets", "counts", "bucket", "s", "t", "_at", "_range", "place", "row")})
    target = [rows[3][1], "bema niro bema", None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60, 100):
        got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(every, wanted, percent=percent).collect())
        assert got == _resample([*rows, *more], target, percent)


def test_resampling_of_nothing(spark, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), none).collect())
    assert got == _resample([(1, "one two"), (2, None)], [])


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_warc", "op4_minhash_near_dedup", "op7_line_dedup", "op9_lm_scoring", "op11_importance_resampling", "op12_source_divergence"])
def test_query_equals_its_sql(spark, name):
    """Each query of the subpackage that SQL can express, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from lumenlake.llm import oracle, queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(oracle.SQL[name])
    columns = sorted(want.columns)
    key = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert Counter(map(key, (tuple(r) for r in got.select(*columns).collect()))) == Counter(map(key, want.project(", ".join(columns)).fetchall()))


def test_every_sql_is_tested():
    from lumenlake.llm import oracle

    assert set(oracle.SQL) == {"op2_substring_dedup", "op3_warc", "op4_minhash_near_dedup", "op7_line_dedup", "op9_lm_scoring", "op11_importance_resampling", "op12_source_divergence"}
