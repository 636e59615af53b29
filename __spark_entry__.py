"""Queries over the parquet test tables, and the SQL that checks them.

Every query runs an operator of the package over the whole comment view (or ``events``).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from parley.config import CleanOptions  # noqa: E402
from parley.functions import text as tx  # noqa: E402
from parley.operators import clusters, controversy, filters, keywords, neardup, sampling, stats, trends, wordpass  # noqa: E402
from parley.plans.report import build_report, publish_report  # noqa: E402
from parley.plans.storage import scratch_path, written  # noqa: E402
from parley.plans.tables import comments, spread, stream_table, table  # noqa: E402
from parley.plans.topics import topic_tables  # noqa: E402
from parley.sources.comments import load_comments, normalize_columns, select_comments, typed  # noqa: E402
from parley.sources.publish import read_published  # noqa: E402
from parley.sources.sinks import write_table  # noqa: E402
from parley.streaming.bursts import BURSTS, stream_bursts  # noqa: E402
from parley.streaming.windows import closed_window_counts, with_open_windows  # noqa: E402

try:
    import parley.llm.registry as llm  # noqa: E402
except ImportError:
    # The subpackage, the pipeline or something that they need is absent: the other queries do without.
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _dated(df: DataFrame) -> DataFrame:
    """Window starts as text, which reads the same in every engine."""
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir, "id", "body")
    rows = tx.staged(rows, "clean_text", tx.clean_text(F.col("body")))
    rows = tx.staged(rows, "again", tx.clean_again(F.col("clean_text")))
    return tx.staged(rows, "tokens", tx.split_tokens(F.col("again")))


def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.preprocess(comments(spark, sf_dir, "id", "body", "subreddit"), text="body")


def _analysis(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return filters.analysis_rows(comments(spark, sf_dir, *columns))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "body", "subreddit", "controversiality", "score", "author")
    path = scratch_path(spark, "comments-csv")
    write_table(comments(spark, sf_dir, *columns), path)
    return load_comments(spark, path, profile="raw").select(*columns)


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = comments(spark, sf_dir, "id", "body", "subreddit", "score", "author").toDF(
        "ID", "Comment_Body", "SR", "Ups", "UserName"
    )
    return typed(normalize_columns(raw)).select("id", "text", "subreddit", "score", "author")


def load_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = comments(spark, sf_dir, "id", "body", "subreddit", "score", "timestamp")
    loaded = select_comments(raw, subreddits=["src1", "src2", "src3"], min_score=10)
    return loaded.select("id", "subreddit", "score", "clean_text", "token_count")


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole load job from CSV files with other names in their header: the first comments, two filters, cleaning."""
    raw = comments(spark, sf_dir, "id", "body", "subreddit", "score").toDF("ID", "Comment", "Sub", "Points")
    path = scratch_path(spark, "comments-csv")
    write_table(raw, path)
    wanted = dict(num_comments=400, random_sample=False, subreddits=["src1", "src2", "src3", "src4"], min_score=5)
    return load_comments(spark, path, **wanted).select("id", "subreddit", "score", "clean_text", "token_count")


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the load job read, dropped and kept, as seen while it wrote its rows."""
    rows, seen = stats.observed_analysis_rows(comments(spark, sf_dir, "id", "body", "subreddit"))
    written(rows, "analysis-rows")
    names = ("total", "without_text", "without_subreddit", "too_short", "valid")
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages and their addresses through the cleaner: links, entities, tables, quoted lines."""
    pages = spark.read.schema("page_id bigint, url string, html string").parquet(f"{sf_dir}/pages.parquet")
    text = F.concat_ws("\n", "html", "url")
    return spread(pages, "page_id").select("page_id", tx.clean_text(text).alias("clean_text"))


def published_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of a report that was published as a whole, as its readers see it."""
    path = scratch_path(spark, "published-report")
    publish_report(build_report(comments(spark, sf_dir)), path, "parquet")
    return _rounded(read_published(spark, path)["subreddit_controversy_rates"], "controversy_rate")


def demo_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(topic_tables(_preprocessed(spark, sf_dir), "demo", method=None)["hot_ngrams"], "weight")


def subreddit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _preprocessed(spark, sf_dir).select("id", "subreddit", "token_count")
    scores = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.floor("value").cast("bigint").alias("score")
    )
    return stats.subreddit_stats(counted.join(scores, "id", "left"))


def controversy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(
        spark, sf_dir, "subreddit", "controversiality", "score", comment_length=tx.comment_length(F.col("body"))
    )
    usable = rows.filter(F.col("subreddit").isNotNull() & (F.col("comment_length") >= 10))
    return controversy.controversy_stats(usable)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_flags(spark, sf_dir).transform(controversy.controversy_rate_by_subreddit)


def _group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir, "subreddit", "controversiality", comment_length=tx.comment_length(F.col("body")))
    return rows.filter(F.col("comment_length") >= 10)


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.compute_tfidf(_analysis(spark, sf_dir, "body", "subreddit"))


def differential(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    rows = _analysis(spark, sf_dir, "id", "body", "subreddit", "controversiality")
    return _rounded(controversy.differential_keywords(rows, **options), "score")


def hot_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.hot_ngrams(_preprocessed(spark, sf_dir)), "weight")


def _one_pass_report(name: str) -> Query:
    """A table of the report, rolled up from counts that one reading of the texts has written."""
    return lambda spark, sf_dir: build_report(comments(spark, sf_dir), stage=True)[name]


def one_pass_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = wordpass.word_pass(_analysis(spark, sf_dir, "body", "subreddit", "controversiality"))
    return keywords.rank_vocabulary(wordpass.occurrences(written(counted, "words")))


def burst_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(tx.keyword_words(F.col("body")))
    rows = comments(spark, sf_dir, "timestamp", words=words)
    found = trends.bursts(trends.window_counts(trends.spread_words(rows), F.col("word")))
    return _rounded(_dated(found).withColumnRenamed("key", "word"), "baseline", "ratio")


def _events(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("ts").cast("timestamp").alias("timestamp"), "event_type")


def burst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by the day, at a threshold that ordinary days reach as well."""
    counts = trends.window_counts(_events(table(spark, sf_dir, "events")), F.col("event_type"))
    found = trends.bursts(counts, threshold=1.0)
    return _rounded(_dated(found).withColumnRenamed("key", "event_type"), "baseline", "ratio")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, stream = table(spark, sf_dir, "events"), stream_table(spark, sf_dir, "events")
    path = scratch_path(spark, "stream-windows")
    closed_window_counts(_events(stream), f"{path}/counts", f"{path}/state", F.col("event_type"))
    closed = spark.read.schema("window_start timestamp, key string, n bigint").parquet(f"{path}/counts")
    counts = with_open_windows(closed, _events(raw), F.col("event_type"))
    return _dated(counts).withColumnRenamed("key", "event_type")


def streamed_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts of ``burst_events`` whose windows the stream has closed, found by the stream itself."""
    raw, stream = table(spark, sf_dir, "events"), stream_table(spark, sf_dir, "events")
    path = scratch_path(spark, "stream-bursts")
    origin = _events(raw).agg(F.min("timestamp").alias("first")).select(F.window("first", "24 hours").start).first()[0]
    stream_bursts(_events(stream), f"{path}/bursts", f"{path}/state", F.col("event_type"), origin, threshold=1.0)
    found = spark.read.schema(BURSTS).parquet(f"{path}/bursts")
    return _rounded(_dated(found).withColumnRenamed("key", "event_type"), "baseline", "ratio")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neardup.near_dup_pairs(comments(spark, sf_dir, "id", "body")), "jaccard")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = neardup.fold_duplicates(comments(spark, sf_dir, "id", "body", "subreddit"))
    return kept.select("id", "subreddit", "group_size")


def _folded_copies(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = comments(spark, sf_dir, "id", "body", "score")
        kept = neardup.fold_groups(rows, neardup.exact_copy_groups(rows), strategy)
        return kept.select("id", "score", "group_size")

    return query


def _opinion_clusters(method: str) -> Query:
    return lambda spark, sf_dir: clusters.opinion_clusters(_preprocessed(spark, sf_dir), method=method)


def entry(spark: SparkSession) -> DataFrame:
    """Keywords of each community in the smallest test set, as the report shows them."""
    return build_report(comments(spark, SMOKE_DIR))["tfidf_keywords"]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # Sources and samples
    q["csv_round_trip"] = csv_round_trip
    q["normalize_columns"] = normalize
    q["load_comments"] = load_job
    q["load_csv_comments"] = load_csv
    q["load_metrics"] = load_metrics
    q["first_n"] = lambda s, d: sampling.first_n(comments(s, d, "id", "subreddit", "body"), 200)
    q["sample_n"] = lambda s, d: sampling.sample_n(comments(s, d, "id", "subreddit", "body"), 150)
    q["stratified_sample"] = lambda s, d: sampling.stratified_sample(
        comments(s, d, "id", "subreddit", "controversiality", "body"), 30
    )
    # Filters
    q["filter_subreddits"] = lambda s, d: filters.in_subreddits(
        comments(s, d, "id", "subreddit", "body"), ["src1", "src7"]
    )
    q["filter_min_score"] = lambda s, d: filters.with_min_score(comments(s, d, "id", "subreddit", "score"), 50)
    q["comments_by_subreddit"] = lambda s, d: filters.of_subreddit(comments(s, d, "id", "subreddit", "body"), "src3")
    q["valid_comments"] = lambda s, d: filters.valid_text(
        comments(s, d, "id", "body"), CleanOptions(max_length=5000), text="body"
    )
    q["analysis_input"] = lambda s, d: _analysis(s, d, "id", "subreddit", "body")
    q["controversy_split"] = lambda s, d: filters.controversy_split(comments(s, d, "id", "controversiality")).drop(
        "controversiality"
    )
    # Text
    q["comment_length"] = lambda s, d: controversy.with_comment_length(comments(s, d, "id", "body")).drop("body")
    q["clean_comments"] = lambda s, d: comments(s, d, "id", "body").select("id", tx.clean_text(F.col("body")).alias("clean_text"))
    q["clean_pages"] = clean_pages
    q["tokenize"] = lambda s, d: _with_tokens(s, d).select(
        "id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("token_count")
    )
    q["ngrams"] = lambda s, d: _with_tokens(s, d).select(
        "id", F.array_join(tx.ngrams(F.col("tokens"), 2), "|").alias("bigrams")
    )
    q["ngrams_1_3"] = lambda s, d: _with_tokens(s, d).select(
        "id", F.array_join(tx.ngram_range(F.col("tokens"), 1, 3), "|").alias("grams")
    )
    q["shingles"] = lambda s, d: tx.staged(comments(s, d, "id", "body"), "clean_text", tx.clean_text(F.col("body"))).select(
        "id", F.array_join(F.sort_array(tx.split_shingles(F.col("clean_text"))), "|").alias("shingles")
    )
    q["keyword_words"] = lambda s, d: _analysis(s, d, "id", "subreddit", "body").select(
        "id", F.array_join(tx.keyword_words(F.col("body")), " ").alias("words")
    )
    q["preprocessed"] = lambda s, d: _preprocessed(s, d).select(
        "id", "subreddit", "clean_text", F.array_join("tokens", " ").alias("tokens"), "token_count"
    )
    # Counts
    q["docs_per_group"] = lambda s, d: stats.docs_per_group(comments(s, d, "subreddit"))
    q["group_word_df"] = lambda s, d: keywords.group_word_df(_analysis(s, d, "body", "subreddit"))
    q["group_word_total"] = lambda s, d: keywords.group_word_total(_analysis(s, d, "body", "subreddit"))
    q["word_group_freq"] = lambda s, d: keywords.word_group_freq(_analysis(s, d, "body", "subreddit"))
    q["word_count"] = lambda s, d: controversy.word_counts_by_side(
        _analysis(s, d, "body", "subreddit", "controversiality")
    )
    q["distinct_subreddits"] = lambda s, d: stats.distinct_subreddits(_analysis(s, d, "body", "subreddit"))
    q["count_subreddits"] = lambda s, d: stats.count_subreddits(_analysis(s, d, "body", "subreddit"))
    q["valid_share"] = lambda s, d: _rounded(stats.valid_share(comments(s, d, "body", "subreddit")), "valid_percent")
    q["subreddit_stats"] = subreddit_stats
    # Controversy
    q["controversy_stats"] = lambda s, d: _rounded(
        controversy_stats(s, d),
        "controversy_rate",
        "avg_length_controversial",
        "avg_length_non_controversial",
        "avg_score_controversial",
        "avg_score_non_controversial",
    )
    q["controversy_stats_long"] = lambda s, d: controversy.stats_long(controversy_stats(s, d))
    q["controversy_rate_by_subreddit"] = lambda s, d: _rounded(rates(s, d), "controversy_rate")
    q["subreddit_controversy_rates"] = lambda s, d: _rounded(
        build_report(comments(s, d))["subreddit_controversy_rates"], "controversy_rate"
    )
    q["top_controversial"] = lambda s, d: _rounded(
        controversy.top_controversial(_group_flags(s, d), 5), "controversy_rate"
    )
    q["published_rates"] = published_rates
    # Keywords
    q["tfidf_keywords"] = tfidf
    q["differential_keywords"] = differential
    q["differential_keywords_sampled"] = lambda s, d: differential(s, d, sample_size=30, candidates=300)
    q["keyword_comparison"] = lambda s, d: controversy.keyword_comparison(differential(s, d))
    q["top_keyword_groups"] = lambda s, d: keywords.top_keyword_groups(tfidf(s, d))
    q["unique_vocabulary"] = lambda s, d: keywords.unique_vocabulary(_analysis(s, d, "body", "subreddit"))
    # The report from one reading of the texts
    q["report_tfidf_keywords"] = _one_pass_report("tfidf_keywords")
    q["report_controversy_stats"] = _one_pass_report("controversy_stats")
    q["report_controversy_rates"] = lambda s, d: _rounded(
        _one_pass_report("subreddit_controversy_rates")(s, d), "controversy_rate"
    )
    q["report_keyword_comparison"] = lambda s, d: _rounded(_one_pass_report("keyword_comparison")(s, d), "score")
    q["report_unique_vocabulary"] = one_pass_vocabulary
    # Trends
    q["hot_ngrams"] = hot_ngrams
    q["hot_ngrams_demo"] = demo_topics
    q["burst_words"] = burst_words
    q["burst_events"] = burst_events
    q["stream_window_counts"] = stream_window_counts
    q["stream_bursts"] = streamed_bursts
    # Near duplicates and clusters
    q["near_dup_candidates"] = lambda s, d: neardup.near_dup_candidates(comments(s, d, "id", "body"))
    q["near_dup_pairs"] = near_dup_pairs
    q["near_dup_members"] = lambda s, d: neardup.near_dup_members(comments(s, d, "id", "body"))
    q["folded_comments"] = folded
    q["folded_copies_first"] = _folded_copies("first")
    q["folded_copies_longest"] = _folded_copies("longest")
    q["folded_copies_highest_score"] = _folded_copies("highest_score")
    q["opinion_clusters"] = _opinion_clusters("kmeans")
    q["opinion_clusters_hierarchical"] = _opinion_clusters("hierarchical")
    return q | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | (llm.oracle_sql() if llm else {})
