"""SQL for DuckDB that must give the same rows as the Spark queries of ``__spark_entry__``.

The SQL is written against the same parquet tables and shares only word lists with the package.
RE2 has no back-references, so a run of equal characters is spelled out per character.
"""

from __future__ import annotations

from parley.config import CLEANER_STOP_WORDS, KEYWORD_STOP_WORDS

COMMENTS = """comments AS (
  SELECT d.doc_id AS id, d.text AS body, d.source AS subreddit,
         coalesce(l.toxic, 0) AS controversiality,
         CAST(floor(e.value) AS BIGINT) AS score,
         CAST(e.user_id AS VARCHAR) AS author, e.ts AS timestamp
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
                   LEFT JOIN events e ON d.doc_id = e.event_id)"""


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


# ASCII and Latin letters, marks and blanks; the newline ends a line and never repeats.
_CHARACTERS = [0x09, 0x0D, *range(0x20, 0x7F), *range(0xA0, 0x180)]
FOUR_EQUAL = "|".join(rf"\x{{{c:X}}}{{4,}}" for c in _CHARACTERS)
THREE_EQUAL = "|".join(f"{c}{{3}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789'-")


def clean(text: str) -> str:
    """The cleaning chain around a SQL expression."""
    steps = [
        (r"(?m)^>[^\n]*$", ""),
        (r"\|[^\n]*\|", " "),
        (r":?-{2,}:?", " "),
        (r"\*{1,2}[^*]+\*{1,2}", " "),
        (FOUR_EQUAL, " "),
        (r"&[a-zA-Z]+;", " "),
        (r"&#x?[0-9a-fA-F]+;?", " "),
        (r"x[0-9a-fA-F]{4}", " "),
        (r"http[s]?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", " "),
        (r"@[\p{L}\p{N}_]+", " "),
    ]
    for pattern, replacement in steps:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{replacement}', 'g')"
    return f"trim(regexp_replace(lower({text}), '[^a-zA-Z0-9''-]+', ' ', 'g'))"


def split_tokens(clean_text: str) -> str:
    noise = rf"^[0-9]+$|^[-*=_|:]+$|{THREE_EQUAL}".replace("'", "''")
    return (
        f"list_filter(string_split({clean_text}, ' '), lambda t: length(t) > 1 "
        f"AND t NOT IN ({_quoted(CLEANER_STOP_WORDS)}) AND NOT regexp_matches(t, '{noise}'))"
    )


VALID = r"""length(body) >= 10
  AND NOT regexp_matches(body, '^\[deleted\]\n?$|^\[removed\]\n?$')"""

# Every comment with its tokens, valid or not.
TOKENS = f"""{COMMENTS},
cleaned AS MATERIALIZED (SELECT *, {clean("body")} AS clean_text FROM comments),
recleaned AS MATERIALIZED (SELECT *, {clean("clean_text")} AS again FROM cleaned),
tokenized AS MATERIALIZED (SELECT * EXCLUDE (again), {split_tokens("again")} AS tokens FROM recleaned)"""

# As the load job leaves them.
PREPROCESSED = f"""{TOKENS},
preprocessed AS (
  SELECT *, CAST(len(tokens) AS INTEGER) AS token_count FROM tokenized
  WHERE {VALID} AND len(tokens) >= 3)"""


def ngrams(n: int) -> str:
    return (
        f"CASE WHEN len(tokens) >= {n} THEN list_transform(range(1, CAST(len(tokens) AS BIGINT) - {n - 2}), "
        f"lambda i: array_to_string(list_slice(tokens, i, i + {n - 1}), ' ')) ELSE [] END"
    )


ANALYSIS = f"""{COMMENTS},
analysis AS (SELECT * FROM comments WHERE body IS NOT NULL AND subreddit IS NOT NULL AND length(body) >= 10)"""

KEYWORD_WORDS = rf"""list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[a-z]{{3,15}}') AND w NOT IN ({_quoted(KEYWORD_STOP_WORDS)}))"""

WORDS = f"""{ANALYSIS},
worded AS MATERIALIZED (SELECT *, {KEYWORD_WORDS} AS words FROM analysis)"""

GROUP_WORDS = f"""{WORDS},
group_words AS MATERIALIZED (
  SELECT subreddit, word, count(*) AS doc_count
  FROM (SELECT subreddit, unnest(list_distinct(words)) AS word FROM worded) GROUP BY ALL),
totals AS (SELECT subreddit, CAST(sum(doc_count) AS BIGINT) AS total FROM group_words GROUP BY ALL),
freqs AS (SELECT word, count(*) AS group_count FROM group_words GROUP BY ALL)"""

TFIDF = f"""{GROUP_WORDS},
scored AS (
  SELECT subreddit, word, (CAST(doc_count AS DOUBLE) / total) * ln(
           CAST((SELECT count(*) FROM analysis) AS DOUBLE) / group_count) AS score
  FROM group_words JOIN totals USING (subreddit) JOIN freqs USING (word) WHERE doc_count >= 5),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, word) AS rn FROM scored),
keywords AS (
  SELECT subreddit, CAST(rn AS INTEGER) AS rank, word AS keyword, round(score, 6) AS tfidf_score
  FROM ranked WHERE rn <= 20)"""

STATS = f"""{ANALYSIS},
stats AS (
  SELECT count(*) AS total_comments,
    count(*) FILTER (controversiality = 1) AS controversial_count,
    count(*) FILTER (controversiality IS DISTINCT FROM 1) AS non_controversial_count,
    CAST(count(*) FILTER (controversiality = 1) AS DOUBLE) / nullif(count(*), 0) * 100 AS controversy_rate,
    avg(length(body)) FILTER (controversiality = 1) AS avg_length_controversial,
    avg(length(body)) FILTER (controversiality IS DISTINCT FROM 1) AS avg_length_non_controversial,
    avg(score) FILTER (controversiality = 1) AS avg_score_controversial,
    avg(score) FILTER (controversiality IS DISTINCT FROM 1) AS avg_score_non_controversial
  FROM analysis)"""


def sampled(relation: str, n: int) -> str:
    return f"""(SELECT * FROM {relation} QUALIFY row_number() OVER (
      PARTITION BY coalesce(controversiality = 1, false)
      ORDER BY md5(concat(CAST(id AS VARCHAR), '42')), id) <= {n})"""


def differential(n: int | None = None, candidates: int | None = None) -> str:
    rows = "worded" if n is None else sampled("worded", n)
    limit = "" if candidates is None else f"LIMIT {candidates}"
    return f"""{WORDS},
side_words AS (
  SELECT coalesce(controversiality = 1, false) AS hit, unnest(words) AS word FROM {rows}),
counts AS MATERIALIZED (
  SELECT word, count(*) FILTER (hit) AS c, count(*) FILTER (NOT hit) AS nc FROM side_words GROUP BY word),
sums AS (SELECT sum(c) AS c_total, sum(nc) AS nc_total FROM counts),
candidates AS (
  (SELECT 'controversial' AS type, word, c AS own, nc AS other, c_total AS own_total, nc_total AS other_total
   FROM counts, sums ORDER BY c DESC, word {limit})
  UNION ALL
  (SELECT 'non_controversial', word, nc, c, nc_total, c_total FROM counts, sums ORDER BY nc DESC, word {limit})),
differential AS (
  SELECT type, word AS keyword,
    (CAST(own AS DOUBLE) / own_total) / (CAST(other + 1 AS DOUBLE) / (other_total + 1)) AS score,
    row_number() OVER (PARTITION BY type ORDER BY
      (CAST(own AS DOUBLE) / own_total) / (CAST(other + 1 AS DOUBLE) / (other_total + 1)) DESC, word) AS rn
  FROM candidates WHERE own >= 10 AND own_total > 0 AND other_total > 0)"""


DAY = "strftime(window_start, '%Y-%m-%d %H:%M:%S')"


def bursts(relation: str, key: str, threshold: float) -> str:
    """Windows of a day against the mean of all days before, absent days counting as zero."""
    return f"""days AS (SELECT time_bucket(INTERVAL '24 hours', ts) AS window_start, {key}, count(*) AS n
               FROM {relation} GROUP BY ALL),
      first_day AS (SELECT min(window_start) AS first_start FROM days),
      sums AS (
        SELECT a.window_start, a.{key}, a.n, CAST(sum(b.n) AS DOUBLE) AS before
        FROM days a JOIN days b ON a.{key} = b.{key} AND b.window_start < a.window_start
        GROUP BY a.window_start, a.{key}, a.n),
      history AS (SELECT *, before / date_diff('day', first_start, window_start) AS baseline FROM sums, first_day),
      bursts AS (SELECT * FROM history WHERE n / baseline >= {threshold})"""


RATES = f"""{ANALYSIS},
rates AS (
  SELECT subreddit, CAST(coalesce(sum(controversiality), 0) AS BIGINT) AS controversial,
    count(controversiality) AS total,
    CAST(coalesce(sum(controversiality), 0) AS DOUBLE) / nullif(count(controversiality), 0) * 100 AS controversy_rate
  FROM analysis GROUP BY subreddit)"""

_TOKEN_TEXT = "array_to_string(tokens, ' ')"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # Sources and samples
    q["csv_round_trip"] = f"WITH {COMMENTS} SELECT id, body, subreddit, controversiality, score, author FROM comments"
    q["normalize_columns"] = (
        f"WITH {COMMENTS} SELECT id, body AS text, subreddit, score, author FROM comments"
    )
    q["load_comments"] = (
        f"WITH {PREPROCESSED} SELECT id, subreddit, score, clean_text, token_count FROM preprocessed "
        "WHERE subreddit IN ('src1', 'src2', 'src3') AND score >= 10"
    )
    q["load_csv_comments"] = (
        f"WITH {PREPROCESSED} SELECT id, subreddit, score, clean_text, token_count FROM preprocessed "
        "WHERE subreddit IN ('src1', 'src2', 'src3', 'src4') AND score >= 5 "
        "AND id IN (SELECT id FROM comments ORDER BY id LIMIT 400)"
    )
    q["load_metrics"] = f"""WITH {COMMENTS} SELECT count(*) AS total, count(*) FILTER (body IS NULL) AS without_text,
      count(*) FILTER (body IS NOT NULL AND subreddit IS NULL) AS without_subreddit,
      count(*) FILTER (body IS NOT NULL AND subreddit IS NOT NULL AND length(body) < 10) AS too_short,
      count(*) FILTER (body IS NOT NULL AND subreddit IS NOT NULL AND length(body) >= 10) AS valid FROM comments"""
    q["first_n"] = f"WITH {COMMENTS} SELECT id, subreddit, body FROM comments ORDER BY id LIMIT 200"
    q["sample_n"] = (
        f"WITH {COMMENTS} SELECT id, subreddit, body FROM comments "
        "ORDER BY md5(concat(CAST(id AS VARCHAR), '42')), id LIMIT 150"
    )
    q["stratified_sample"] = (
        f"WITH {COMMENTS} SELECT id, subreddit, controversiality, body FROM {sampled('comments', 30)}"
    )
    # Filters
    q["filter_subreddits"] = (
        f"WITH {COMMENTS} SELECT id, subreddit, body FROM comments WHERE subreddit IN ('src1', 'src7')"
    )
    q["filter_min_score"] = f"WITH {COMMENTS} SELECT id, subreddit, score FROM comments WHERE score >= 50"
    q["comments_by_subreddit"] = f"WITH {COMMENTS} SELECT id, subreddit, body FROM comments WHERE subreddit = 'src3'"
    q["valid_comments"] = f"WITH {COMMENTS} SELECT id, body FROM comments WHERE length(body) <= 5000 AND {VALID}"
    q["analysis_input"] = f"WITH {ANALYSIS} SELECT id, subreddit, body FROM analysis"
    q["controversy_split"] = (
        f"WITH {COMMENTS} SELECT id, coalesce(controversiality = 1, false) AS is_controversial FROM comments"
    )
    # Text
    q["comment_length"] = f"WITH {COMMENTS} SELECT id, CAST(length(body) AS INTEGER) AS comment_length FROM comments"
    q["clean_comments"] = f"WITH {COMMENTS} SELECT id, {clean('body')} AS clean_text FROM comments"
    q["tokenize"] = (
        f"WITH {TOKENS} SELECT id, {_TOKEN_TEXT} AS tokens, CAST(len(tokens) AS INTEGER) AS token_count FROM tokenized"
    )
    q["ngrams"] = f"WITH {TOKENS} SELECT id, array_to_string({ngrams(2)}, '|') AS bigrams FROM tokenized"
    q["ngrams_1_3"] = (
        f"WITH {TOKENS} SELECT id, array_to_string(list_concat({ngrams(1)}, list_concat({ngrams(2)}, {ngrams(3)})), '|') "
        "AS grams FROM tokenized"
    )
    q["shingles"] = f"""WITH {COMMENTS},
      cleaned AS MATERIALIZED (SELECT id, {clean("body")} AS c FROM comments)
      SELECT id, CASE WHEN c = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(
        range(1, greatest(length(c) - 3, 2)), lambda i: substr(c, i, 5)))), '|') END AS shingles FROM cleaned"""
    q["keyword_words"] = f"WITH {WORDS} SELECT id, array_to_string(words, ' ') AS words FROM worded"
    q["preprocessed"] = (
        f"WITH {PREPROCESSED} SELECT id, subreddit, clean_text, {_TOKEN_TEXT} AS tokens, token_count FROM preprocessed"
    )
    # Counts
    q["docs_per_group"] = f"WITH {COMMENTS} SELECT subreddit, count(*) AS doc_count FROM comments GROUP BY subreddit"
    q["group_word_df"] = f"WITH {GROUP_WORDS} SELECT subreddit, word, doc_count FROM group_words"
    q["group_word_total"] = f"WITH {GROUP_WORDS} SELECT subreddit, total FROM totals"
    q["word_group_freq"] = f"WITH {GROUP_WORDS} SELECT word, group_count FROM freqs"
    q["word_count"] = f"""WITH {WORDS},
      u AS (SELECT coalesce(controversiality = 1, false) AS hit, unnest(words) AS word FROM worded)
      SELECT word, count(*) FILTER (hit) AS controversial_count, count(*) FILTER (NOT hit) AS non_controversial_count
      FROM u GROUP BY word"""
    q["distinct_subreddits"] = f"WITH {ANALYSIS} SELECT DISTINCT subreddit FROM analysis"
    q["count_subreddits"] = f"WITH {ANALYSIS} SELECT count(DISTINCT subreddit) AS subreddits FROM analysis"
    q["valid_share"] = f"""WITH {COMMENTS} SELECT count(*) AS total,
      count(*) FILTER (body IS NOT NULL AND subreddit IS NOT NULL AND length(body) >= 10) AS valid,
      round(100 * CAST(count(*) FILTER (body IS NOT NULL AND subreddit IS NOT NULL AND length(body) >= 10) AS DOUBLE)
        / count(*), 6) AS valid_percent FROM comments"""
    q["subreddit_stats"] = f"""WITH {PREPROCESSED} SELECT subreddit, count(id) AS count,
      round_even(avg(score), 2) AS avg_score, CAST(sum(score) AS BIGINT) AS total_score,
      round_even(avg(token_count), 2) AS avg_tokens FROM preprocessed GROUP BY subreddit"""
    # Controversy
    q["controversy_stats"] = f"""WITH {STATS} SELECT total_comments, controversial_count, non_controversial_count,
      round(controversy_rate, 6) AS controversy_rate,
      round(avg_length_controversial, 6) AS avg_length_controversial,
      round(avg_length_non_controversial, 6) AS avg_length_non_controversial,
      round(avg_score_controversial, 6) AS avg_score_controversial,
      round(avg_score_non_controversial, 6) AS avg_score_non_controversial FROM stats"""
    lines = [
        ("Total Comments", "CAST(total_comments AS VARCHAR)"),
        ("Controversial", "CAST(controversial_count AS VARCHAR)"),
        ("Non-controversial", "CAST(non_controversial_count AS VARCHAR)"),
        ("Controversy Rate (%)", "printf('%.2f', controversy_rate)"),
        ("Avg Length (Controversial)", "printf('%.1f', avg_length_controversial)"),
        ("Avg Length (Non-controversial)", "printf('%.1f', avg_length_non_controversial)"),
        ("Avg Score (Controversial)", "printf('%.2f', avg_score_controversial)"),
        ("Avg Score (Non-controversial)", "printf('%.2f', avg_score_non_controversial)"),
    ]
    q["controversy_stats_long"] = f"WITH {STATS} " + " UNION ALL ".join(
        f"""SELECT '{label}' AS "Metric", {value} AS "Value" FROM stats""" for label, value in lines
    )
    q["controversy_rate_by_subreddit"] = (
        f"WITH {RATES} SELECT subreddit, controversial, total, round(controversy_rate, 6) AS controversy_rate FROM rates"
    )
    q["subreddit_controversy_rates"] = (
        f"WITH {RATES} SELECT subreddit, round(controversy_rate, 6) AS controversy_rate FROM rates"
    )
    q["top_controversial"] = f"""WITH {RATES} SELECT subreddit, controversial, total,
      round(controversy_rate, 6) AS controversy_rate FROM rates
      ORDER BY rates.controversy_rate DESC NULLS LAST, subreddit LIMIT 5"""
    # Keywords
    q["tfidf_keywords"] = f"WITH {TFIDF} SELECT subreddit, rank, keyword, tfidf_score FROM keywords"
    q["differential_keywords"] = f"""WITH {differential()} SELECT type, CAST(rn AS INTEGER) AS rank, keyword,
      round(score, 6) AS score FROM differential WHERE rn <= 50"""
    q["differential_keywords_sampled"] = f"""WITH {differential(30, 300)} SELECT type, CAST(rn AS INTEGER) AS rank, keyword,
      round(score, 6) AS score FROM differential WHERE rn <= 50"""
    q["keyword_comparison"] = f"""WITH {differential()} SELECT type, keyword, round(score, 6) AS score
      FROM differential WHERE rn <= 30"""
    q["top_keyword_groups"] = f"""WITH {TFIDF},
      largest AS (SELECT subreddit, count(*) AS keyword_count FROM keywords GROUP BY subreddit
                  ORDER BY keyword_count DESC, subreddit LIMIT 6)
      SELECT subreddit, rank, keyword, tfidf_score, keyword_count FROM keywords JOIN largest USING (subreddit)
      WHERE rank <= 10"""
    q["unique_vocabulary"] = f"""WITH {WORDS},
      group_words AS MATERIALIZED (SELECT subreddit, word, count(*) AS n
        FROM (SELECT subreddit, unnest(words) AS word FROM worded) GROUP BY ALL),
      totals AS (SELECT subreddit, sum(n) AS total FROM group_words GROUP BY ALL),
      everywhere AS (SELECT word, sum(n) AS word_total FROM group_words GROUP BY ALL),
      scored AS (
        SELECT subreddit, word, (CAST(n AS DOUBLE) / total)
          / (CAST(word_total - n + 1 AS DOUBLE) / ((SELECT sum(n) FROM group_words) - total + 1)) AS score
        FROM group_words JOIN totals USING (subreddit) JOIN everywhere USING (word)
        WHERE n >= 5 AND (SELECT sum(n) FROM group_words) > total),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, word) AS rn FROM scored)
      SELECT subreddit, CAST(rn AS INTEGER) AS rank, word, round(score, 6) AS specificity_score
      FROM ranked WHERE rn <= 20"""
    # Trends
    q["hot_ngrams"] = f"""WITH {PREPROCESSED},
      grams AS (SELECT id, unnest(list_concat({ngrams(1)}, list_concat({ngrams(2)}, {ngrams(3)}))) AS ngram
                FROM preprocessed),
      counts AS (SELECT ngram, count(*) AS total_count, count(DISTINCT id) AS doc_count FROM grams GROUP BY ngram),
      total AS (SELECT count(*) AS n FROM preprocessed)
      SELECT ngram, total_count, doc_count, round(total_count * ln(CAST(n AS DOUBLE) / doc_count), 6) AS weight
      FROM counts, total WHERE doc_count >= 5 AND doc_count <= 0.5 * n
      ORDER BY total_count * ln(CAST(n AS DOUBLE) / doc_count) DESC, ngram LIMIT 10"""
    q["hot_ngrams_demo"] = q["hot_ngrams"].removesuffix("10") + "5"
    q["burst_words"] = f"""WITH {COMMENTS},
      mentions AS (SELECT timestamp AS ts, unnest(list_distinct({KEYWORD_WORDS})) AS word FROM comments),
      {bursts("mentions", "word", 2.0)}
      SELECT {DAY} AS window_start, word, n, round(baseline, 6) AS baseline, round(n / baseline, 6) AS ratio FROM bursts"""
    q["burst_events"] = f"""WITH {bursts("events", "event_type", 1.0)}
      SELECT {DAY} AS window_start, event_type, n, round(baseline, 6) AS baseline, round(n / baseline, 6) AS ratio FROM bursts"""
    # The stream closes a window when a row an hour past its end was seen.
    q["stream_bursts"] = f"""{q["burst_events"]}
      WHERE window_start + INTERVAL '25 hours' <= (SELECT max(ts) FROM events)"""
    q["stream_window_counts"] = f"""WITH days AS (SELECT time_bucket(INTERVAL '24 hours', ts) AS window_start,
      event_type, count(*) AS n FROM events GROUP BY ALL) SELECT {DAY} AS window_start, event_type, n FROM days"""
    # Copies
    for strategy, order in (("first", "id"), ("longest", "length(body) DESC, id"), ("highest_score", "score DESC, id")):
        q[f"folded_copies_{strategy}"] = f"""WITH {COMMENTS},
          cleaned AS MATERIALIZED (SELECT *, {clean("body")} AS c FROM comments),
          grouped AS (SELECT *, CASE WHEN c = '' THEN CAST(id AS VARCHAR) ELSE '#' || c END AS g FROM cleaned)
          SELECT id, score, count(*) OVER (PARTITION BY g) AS group_size FROM grouped
          QUALIFY row_number() OVER (PARTITION BY g ORDER BY {order}) = 1"""
    q["clean_pages"] = f"SELECT page_id, {clean("concat_ws(chr(10), html, url)")} AS clean_text FROM pages"
    q["published_rates"] = q["subreddit_controversy_rates"]
    # The report from one reading of the texts: its tables are those of the single queries
    q["report_tfidf_keywords"] = q["tfidf_keywords"]
    q["report_unique_vocabulary"] = q["unique_vocabulary"]
    q["report_keyword_comparison"] = q["keyword_comparison"]
    q["report_controversy_stats"] = q["controversy_stats_long"]
    q["report_controversy_rates"] = q["subreddit_controversy_rates"]
    # Near duplicates: all pairs of different clean texts by their sets of 5-character shingles
    texts = f"""{COMMENTS},
      cleaned AS MATERIALIZED (SELECT id, subreddit, {clean("body")} AS c FROM comments),
      texts AS MATERIALIZED (SELECT c, min(id) AS rep FROM cleaned WHERE c <> '' GROUP BY c)"""
    links = f"""{texts},
      grams AS MATERIALIZED (SELECT DISTINCT rep, substr(c, i, 5) AS g
        FROM (SELECT rep, c, unnest(range(1, greatest(length(c) - 4, 1) + 1)) AS i FROM texts)),
      sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
      common AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
      links AS MATERIALIZED (SELECT a, b, common.n / (p.n + q.n - common.n) AS jaccard
        FROM common JOIN sizes p ON a = p.rep JOIN sizes q ON b = q.rep WHERE 2 * common.n >= p.n + q.n - common.n)"""
    q["near_dup_pairs"] = f"WITH {links} SELECT a AS id_a, b AS id_b, round(jaccard, 6) AS jaccard FROM links"
    q["near_dup_members"] = f"WITH {texts} SELECT id, rep FROM cleaned JOIN texts USING (c)"
    q["folded_comments"] = f"""WITH RECURSIVE {links},
      edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reached AS (SELECT rep AS node, rep AS low FROM texts UNION SELECT e.b, r.low FROM reached r JOIN edges e ON e.a = r.node),
      parts AS (SELECT node, min(low) AS part FROM reached GROUP BY node),
      grouped AS (SELECT id, subreddit, coalesce(part, id) AS g
        FROM cleaned LEFT JOIN texts USING (c) LEFT JOIN parts ON node = rep)
      SELECT id, subreddit, count(*) OVER (PARTITION BY g) AS group_size FROM grouped
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) = 1"""
    return q
