"""SQL that says what operators must return, where SQL can; over whole tables and whole texts."""

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every string of 50 bytes of every text, as hexadecimal digits; places that an earlier document has too, as runs; what is left.
REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h)),
f AS (SELECT s, min(doc_id) AS m FROM t GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t JOIN f USING (s) WHERE doc_id > m),
g AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT p.doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM pieces p JOIN h USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)
"""

#: All pairs that share a shingle, by the sizes of their sets; then the least id that links reach.
NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) q JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a)
SELECT x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id, min(y) = x AS kept FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""

#: Words and places of the base phrases.
LICENCES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
  list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM w)
SELECT doc_id, len(w) AS n_words, len(m) + len(a) + len(g) AS n_base, list_min(m || a || g) - 1 AS first_word, list_max(m || a || g) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p
"""

#: Counts of the plain rules.
QUALITY = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS s FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g WHERE s IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM t, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""

#: Payloads as they were stored.
MEDIA = """
WITH p AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, coalesce(text, '') AS t FROM documents)
SELECT doc_id, n AS n_bytes, greatest((n + 191) // 192, 1) * 192 AS payload_bytes, sha256(t || repeat(' ', (greatest((n + 191) // 192, 1) * 192 - n)::INT)) AS payload_sha256 FROM p
"""

#: CRC-32 of an id's digits, bit by bit.
CRC = "xor(4294967295, list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce(range(8), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(s, b)), 4294967295))"

#: Every pair of equal words of a text with the planted repetition, at most a third of the text apart; unbroken series of pairs at one distance.
RUNS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC.format('doc_id')} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
u AS (SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.x = y.x AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM k GROUP BY doc_id, q, k HAVING count(*) >= greatest(24 - q, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS x, arg_min((start, length, period), (-length / period, start, period)) AS best FROM r GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_words, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(listed.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Every document's full score for every item.
RANKED = f"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS l FROM t),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT item_id, term, times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM i JOIN d USING (term), s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::BIGINT AS score FROM w JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20
"""
