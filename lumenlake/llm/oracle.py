"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM x JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN g USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1),
c AS (SELECT doc_id, string_agg(sh, chr(10) ORDER BY sh) AS whole FROM s GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept, coalesce(k.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM d),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
k AS (SELECT doc_id, line_no, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS tokens FROM w WHERE len(w) >= 1),
s AS (SELECT tokens, min(doc_id * 1000000 + line_no) AS first, row_number() OVER () AS id FROM k GROUP BY tokens),
t AS (SELECT id, first, len(tokens) AS n, unnest(tokens) AS token FROM s),
pairs AS (SELECT b.id, a.id AS earlier, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM t a JOIN t b ON a.token = b.token AND a.first < b.first GROUP BY ALL),
gone AS (SELECT DISTINCT id FROM pairs WHERE 4 * common >= 3 * (n + m - common)),
out AS (SELECT k.doc_id, k.line_no FROM k JOIN s ON k.tokens = s.tokens WHERE k.doc_id * 1000000 + k.line_no > s.first OR s.id IN (SELECT id FROM gone)),
o AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM out GROUP BY ALL)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(o.n, 0)::BIGINT AS n_removed, coalesce(o.removed, '') AS removed FROM d LEFT JOIN o USING (doc_id)
""",
    "op11_importance_resampling": r"""
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(4)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(16) r(i))),
x AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
d AS (SELECT row_number() OVER () AS row, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
t AS (SELECT row, side, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT row, side, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY row ORDER BY i)),
f AS MATERIALIZED (SELECT row, side, a AS f FROM r UNION ALL SELECT row, side, a || ' ' || b FROM r WHERE b IS NOT NULL UNION ALL SELECT row, side, a || ' ' || b || ' ' || c FROM r WHERE c IS NOT NULL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(2, len(h) + 2), lambda i: strpos('0123456789ABCDEF', h[i - 2 * (i % 2):i - 2 * (i % 2)]) - 1)), lambda c, b: xor(c // 16, t[xor(c % 16, b) + 1])), 4294967295) % 10000 AS bucket FROM u, tbl),
n AS (SELECT row, side, bucket, count(*) AS n FROM f JOIN c USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM n GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
v AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (row) WHERE side = 'd'),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM z WHERE words >= 20) THEN place END AS rank FROM k
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS every FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(every)::HUGEINT AS whole FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000::HUGEINT * (k.every + 1) // (v.whole + v.v) AS q
  FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o QUALIFY part = 'pair' OR rank <= 200
""",
    "op9_lm_scoring": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before, lag(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM t),
own1 AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL),
all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY ALL),
own2 AS (SELECT doc_id, before, word, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL),
all2 AS (SELECT before, word, sum(n) AS n FROM own2 GROUP BY ALL),
own3 AS (SELECT doc_id, first, before, word, count(*) AS n FROM p WHERE first IS NOT NULL GROUP BY ALL),
all3 AS (SELECT first, before, word, sum(n) AS n FROM own3 GROUP BY ALL),
size AS (SELECT doc_id, len(w) AS n, sum(len(w)) OVER () AS total FROM d),
x AS (
  SELECT p.doc_id, p.before, p.first,
    all1.n - own1.n AS c, prev.n - mine.n AS b, all2.n - own2.n AS pair, pairs.n - mine2.n AS bb, all3.n - own3.n AS three,
    greatest(size.total - size.n, 1) AS total
  FROM p JOIN size USING (doc_id)
  JOIN own1 ON own1.doc_id = p.doc_id AND own1.word = p.word JOIN all1 ON all1.word = p.word
  LEFT JOIN own1 mine ON mine.doc_id = p.doc_id AND mine.word = p.before LEFT JOIN all1 prev ON prev.word = p.before
  LEFT JOIN own2 ON own2.doc_id = p.doc_id AND own2.before = p.before AND own2.word = p.word
  LEFT JOIN all2 ON all2.before = p.before AND all2.word = p.word
  LEFT JOIN own2 mine2 ON mine2.doc_id = p.doc_id AND mine2.before = p.first AND mine2.word = p.before
  LEFT JOIN all2 pairs ON pairs.before = p.first AND pairs.word = p.before
  LEFT JOIN own3 ON own3.doc_id = p.doc_id AND own3.first = p.first AND own3.before = p.before AND own3.word = p.word
  LEFT JOIN all3 ON all3.first = p.first AND all3.before = p.before AND all3.word = p.word),
y AS (SELECT *, CASE WHEN pair > 0 THEN pair::DOUBLE / b
  ELSE (CASE WHEN before IS NULL THEN 1 ELSE 0.4 END)::DOUBLE * (CASE WHEN c > 0 THEN c ELSE 0.4 END)::DOUBLE / total END AS two FROM x),
s AS (SELECT doc_id, sum(log10(CASE WHEN three > 0 THEN three::DOUBLE / bb WHEN first IS NULL THEN two ELSE 0.4::DOUBLE * two END)) AS total_log FROM y GROUP BY ALL)
SELECT size.doc_id, size.n::BIGINT AS n_words, round(s.total_log / size.n, 6) AS score FROM size LEFT JOIN s USING (doc_id)
""",
}
