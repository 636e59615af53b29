"""The SQL that checks the queries, where SQL can express them."""

from __future__ import annotations

from parley.llm import lm, mixing, quality

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACES}'), lambda w: w <> '')"


def _lm() -> str:
    punctuation = lm.PUNCTUATION.decode()
    plain = f"translate(coalesce(text, ''), {_literal(UPPER + punctuation)}, {_literal(LOWER + ' ' * len(punctuation))})"
    return f"""
WITH docs AS (SELECT doc_id, {_words(plain)} AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
threes AS (
  SELECT doc_id, i, word, lag(word) OVER v AS b, lag(word, 2) OVER v AS a FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
n1 AS (SELECT word, count(*) AS n FROM words GROUP BY word),
n2 AS (SELECT b, word, count(*) AS n FROM threes WHERE b IS NOT NULL GROUP BY b, word),
n3 AS (SELECT a, b, word, count(*) AS n FROM threes WHERE a IS NOT NULL GROUP BY a, b, word),
total AS (SELECT count(*) AS n FROM words),
s1 AS (SELECT word, ln(n1.n / total.n) AS s FROM n1 CROSS JOIN total),
s2 AS (
  SELECT n2.b, n2.word, n2.n, CASE WHEN n2.n >= {lm.LEAST_COUNT} THEN ln(n2.n / c.n) ELSE ln({lm.BACKOFF}::DOUBLE) + s1.s END AS s
  FROM n2 JOIN n1 c ON n2.b = c.word JOIN s1 ON n2.word = s1.word),
s3 AS (
  SELECT n3.a, n3.b, n3.word, CASE WHEN n3.n >= {lm.LEAST_COUNT} THEN ln(n3.n / c.n) ELSE ln({lm.BACKOFF}::DOUBLE) + s2.s END AS s
  FROM n3 JOIN n2 c ON n3.a = c.b AND n3.b = c.word JOIN s2 ON n3.b = s2.b AND n3.word = s2.word),
scored AS (
  SELECT t.doc_id, coalesce(s3.s, s2.s, s1.s) AS s
  FROM threes t JOIN s1 ON t.word = s1.word LEFT JOIN s2 ON t.b = s2.b AND t.word = s2.word
  LEFT JOIN s3 ON t.a = s3.a AND t.b = s3.b AND t.word = s3.word)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(s.total, 0), 3) AS log_score,
       CASE WHEN len(d.w) > 0 THEN round(s.total / len(d.w), 6) END AS mean_log_score
FROM docs d LEFT JOIN (SELECT doc_id, sum(s) AS total FROM scored GROUP BY doc_id) s ON d.doc_id = s.doc_id"""


def _urls() -> str:
    number = "CAST('0x' || substr(md5({}), 1, 6) AS BIGINT)"
    start = "TIMESTAMP '2024-01-01'"
    host = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return f"""
WITH caps AS (
  SELECT page_id, nullif(lower(regexp_replace(regexp_replace({host}, '^.*@', ''), '\\.?(:[0-9]*)?$', '')), '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    {start} + to_seconds({number.format('url')} % 2592000) AS tm
  FROM pages),
hosts AS (SELECT DISTINCT host, {number.format('host')} AS k FROM caps WHERE host IS NOT NULL),
spans AS (
  SELECT k, host, {start} + to_days(CAST(k % 10 AS INT)) AS f, {start} + to_days(CAST(10 + k % 7 AS INT)) AS t FROM hosts
  UNION ALL SELECT k, host, {start} + to_days(CAST(20 + k % 9 AS INT)), NULL FROM hosts),
raw AS (
  SELECT CASE WHEN k % 3 = 0 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE WHEN k % 3 = 0 THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE host || '/en' END AS pattern, f, t
  FROM spans WHERE k % 3 < 2),
changes AS (
  SELECT kind, pattern, 'add' AS action, f AS tm FROM raw UNION
  SELECT kind, pattern, 'remove', t FROM raw WHERE t IS NOT NULL),
valid AS (
  SELECT kind, pattern, action, tm AS f, lead(tm) OVER (PARTITION BY kind, pattern ORDER BY tm, action) AS t FROM changes),
met AS (
  SELECT c.page_id, v.kind || ' ' || v.pattern AS key, length(v.pattern) AS len
  FROM caps c JOIN valid v ON v.action = 'add' AND c.tm >= v.f AND (v.t IS NULL OR c.tm < v.t)
   AND CASE WHEN v.kind = 'domain' THEN c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)
            ELSE starts_with(c.host || c.path || '/', v.pattern || '/') END),
found AS (SELECT page_id, count(*) AS n, arg_min(key, struct_pack(a := -len, b := key)) AS key FROM met GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(f.n, 0) AS n_entries, f.key AS blocked_by, f.n IS NULL AS kept
FROM caps c LEFT JOIN found f ON c.page_id = f.page_id"""


def _exact() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t"""


def _join() -> str:
    plain = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(plain)} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id
  WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON d.doc_id = r.a"""


def _quality() -> str:
    limits, size = quality.QualityLimits(), quality.WINDOW
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {size - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d WHERE len(w) > {size - 1})),
starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
  SELECT doc_id, sum(covered) AS n FROM (
    SELECT doc_id, least({size}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {size})) AS covered FROM starts)
  GROUP BY doc_id),
texts AS (SELECT DISTINCT host, t, lines FROM d),
hosts AS (SELECT host, count(*) AS n FROM texts GROUP BY host),
lines AS (
  SELECT host, t, len({_words("x")}) AS words,
    trim(regexp_replace(regexp_replace(lower(x), '{SPACES}', ' ', 'g'), '[0-9]', '0', 'g')) AS line
  FROM (SELECT host, t, unnest(lines) AS x FROM texts)),
frequent AS (
  SELECT l.host, l.line FROM (SELECT host, line, count(DISTINCT t) AS n FROM lines GROUP BY host, line) l
  JOIN hosts h ON l.host = h.host WHERE l.n > {limits.line_docs} AND l.n > {limits.line_share} * h.n),
cuts AS (
  SELECT l.host, l.t, count(*) AS n_lines, sum(l.words) AS n_words
  FROM lines l JOIN frequent f ON l.host = f.host AND l.line = f.line GROUP BY l.host, l.t),
counted AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
    CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(d.lines) - len(list_distinct(d.lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_cut_lines, CAST(coalesce(c.n_words, 0) AS BIGINT) AS n_cut_words
  FROM d LEFT JOIN repeats r ON d.doc_id = r.doc_id LEFT JOIN cuts c ON d.host = c.host AND d.t = c.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_cut_lines, n_cut_words,
  (n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words)
  AND NOT (n_cut_words > 0 AND (100 * (n_words - n_cut_words) < {limits.left_percent} * n_words
                                OR n_words - n_cut_words < {limits.least_words})) AS kept
FROM counted"""


def _mixing() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size,
    '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS name
  FROM documents),
s AS (
  SELECT source, sum(size) AS n, 3.0 * sum(size) AS cap,
    1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- The level at which the capped and the others make up the whole.
tries AS (
  SELECT ((SELECT sum(n) FROM s) - coalesce(sum(y.cap) FILTER (y.cap / y.w < x.cap / x.w), 0))
      / sum(y.w) FILTER (y.cap / y.w >= x.cap / x.w) AS level, x.cap / x.w AS ratio
  FROM s x CROSS JOIN s y GROUP BY x.source, x.cap, x.w),
lvl AS (SELECT arg_min(level, ratio) AS level FROM tries WHERE level <= ratio),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, CAST(least(cap, w * (SELECT level FROM lvl)) AS DOUBLE) AS target FROM s),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- Every document's uniform number for every seed; a source takes the seed that comes nearest to its target.
drawn AS (
  SELECT r.*, k, CAST('0x' || substr(sha256('{mixing.SEED}|' || (k // 8) || name), 8 * (k % 8) + 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM r CROSS JOIN (SELECT unnest(range(0, {mixing.SEEDS})) AS k)),
sums AS (
  SELECT source, k, abs(sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - max(rate - floor(rate)) * max(source_size)) AS off
  FROM drawn GROUP BY source, k),
best AS (SELECT source, arg_min(k, struct_pack(a := off, b := k)) AS k FROM sums GROUP BY source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn JOIN best ON drawn.source IS NOT DISTINCT FROM best.source AND drawn.k = best.k"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    square = "list_sum(list_transform(list_zip(m.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT m.vec_id, m.p, arg_min(b.e, CAST({square} AS HUGEINT) * {entries} + b.e) AS e, min(CAST({square} AS BIGINT)) AS d
  FROM members m JOIN book{k} b ON m.p = b.p GROUP BY m.vec_id, m.p)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (
  SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS c
  FROM (SELECT n.p, n.e, unnest(m.v) AS x, generate_subscripts(m.v, 1) AS i
        FROM near{k} n JOIN members m ON n.vec_id = m.vec_id AND n.p = m.p) GROUP BY p, e, i),
moved{k} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
positions AS (SELECT unnest(range(0, {parts})) AS p),
members AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept CROSS JOIN positions),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
book0 AS MATERIALIZED (SELECT m.p, f.e, m.v FROM members m JOIN firsts f ON m.vec_id = f.vec_id),{",".join(steps)},
whole AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(e AS INT))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT k.vec_id, w.code, w.error, CAST(sum(w.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept k JOIN whole w ON k.vec_id = w.vec_id CROSS JOIN digest"""


def _lines() -> str:
    return f"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
           FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM d),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _phrases() -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4, lead(w1, 4) OVER s AS w5
  FROM words WINDOW s AS (PARTITION BY p ORDER BY i)),
f AS (
  SELECT lang, [w1] AS g, count(*) AS a FROM runs GROUP BY lang, w1 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM runs WHERE w5 IS NOT NULL GROUP BY lang, w1, w2, w3, w4, w5 HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(g) > 1),
cuts AS (
  SELECT c.lang, c.g, c.a, x.k, p.a AS l, q.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (p.a::HUGEINT * q.a) AS score
  FROM c JOIN (SELECT unnest(range(1, 5)) AS k) x ON x.k < len(c.g)
  JOIN f p ON p.lang = c.lang AND p.g = c.g[1 : x.k] JOIN f q ON q.lang = c.lang AND q.g = c.g[x.k + 1 :]
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i : i + m - 1] AS g, max(a) AS a
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM c JOIN (SELECT unnest(range(2, 5)) AS m) ON m < len(g)) GROUP BY ALL),
left_over AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM lowest b LEFT JOIN inside s ON s.lang = b.lang AND s.g = b.g
              WHERE s.a IS NULL OR s.a < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM left_over QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_scores": _lm(),
        "op4_url_filters": _urls(),
        "op5_exact_dedup": _exact(),
        "op6_ngram_join": _join(),
        "op7_quality_rules": _quality(),
        "op10_mixing": _mixing(),
        "op11_vector_codes": _codes(),
        "op12_line_dedup": _lines(),
        "op13_collocations": _phrases(),
    }
