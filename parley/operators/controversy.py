"""Controversial against other comments: counts, rates, means and telling words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import comment_length, keyword_words
from parley.operators.filters import is_controversial
from parley.operators.sampling import stratified_sample

# Fixed values of the differential ranking.
MIN_COUNT = 10
TOP_WORDS = 50
EXPORT_WORDS = 30


def with_comment_length(df: DataFrame, text_column: str = "body") -> DataFrame:
    return df.withColumn("comment_length", comment_length(F.col(text_column)))


def controversy_stats(df: DataFrame, text_column: str = "body") -> DataFrame:
    """One row: counts, rate, mean length and mean score of both sides.

    A ready ``comment_length`` column is used if there is one, so the text need not travel.
    """
    length = F.col("comment_length") if "comment_length" in df.columns else comment_length(F.col(text_column))
    flagged = is_controversial()
    total, hits = F.count("*"), F.count_if(flagged)
    return df.agg(
        total.alias("total_comments"),
        hits.alias("controversial_count"),
        (total - hits).alias("non_controversial_count"),
        (hits.cast("double") / F.nullif(total, F.lit(0)) * 100).alias("controversy_rate"),
        F.avg(F.when(flagged, length)).alias("avg_length_controversial"),
        F.avg(F.when(~flagged, length)).alias("avg_length_non_controversial"),
        F.avg(F.when(flagged, F.col("score"))).alias("avg_score_controversial"),
        F.avg(F.when(~flagged, F.col("score"))).alias("avg_score_non_controversial"),
    )


def stats_long(stats: DataFrame) -> DataFrame:
    """The statistics row as eight ``Metric, Value`` rows with fixed labels and formats."""
    # Label, column and format of each line of the table.
    lines = [
        ("Total Comments", "total_comments", "%d"),
        ("Controversial", "controversial_count", "%d"),
        ("Non-controversial", "non_controversial_count", "%d"),
        ("Controversy Rate (%)", "controversy_rate", "%.2f"),
        ("Avg Length (Controversial)", "avg_length_controversial", "%.1f"),
        ("Avg Length (Non-controversial)", "avg_length_non_controversial", "%.1f"),
        ("Avg Score (Controversial)", "avg_score_controversial", "%.2f"),
        ("Avg Score (Non-controversial)", "avg_score_non_controversial", "%.2f"),
    ]
    pairs = []
    for label, column, form in lines:
        value = F.when(F.col(column).isNotNull(), F.format_string(form, F.col(column))).otherwise("nan")
        pairs += [F.lit(label), value]
    return stats.select(F.stack(F.lit(len(lines)), *pairs).alias("Metric", "Value"))


def controversy_rate_by_subreddit(df: DataFrame) -> DataFrame:
    """Rate per community over the comments whose flag is known; null where none is."""
    flag = F.col("controversiality")
    per_group = df.filter(F.col("subreddit").isNotNull()).groupBy("subreddit").agg(
        F.sum(flag).alias("controversial"), F.count(flag).alias("total")
    )
    rate = F.coalesce(F.col("controversial"), F.lit(0)).cast("double") / F.nullif("total", F.lit(0)) * 100
    return per_group.select(
        "subreddit", F.coalesce("controversial", F.lit(0)).alias("controversial"), "total", rate.alias("controversy_rate")
    )


def top_controversial(df: DataFrame, n: int = 5) -> DataFrame:
    rates = controversy_rate_by_subreddit(df)
    return rates.orderBy(F.desc_nulls_last("controversy_rate"), "subreddit").limit(n)


def word_counts_by_side(df: DataFrame, text_column: str = "body") -> DataFrame:
    """Occurrences of each word on both sides, counted in one pass."""
    words = df.select(is_controversial().alias("_hit"), F.explode(keyword_words(F.col(text_column))).alias("word"))
    return words.groupBy("word").agg(
        F.count_if(F.col("_hit")).alias("controversial_count"),
        F.count_if(~F.col("_hit")).alias("non_controversial_count"),
    )


# Name of a side, its count, the count of the other side.
SIDES = (
    ("controversial", "controversial_count", "non_controversial_count"),
    ("non_controversial", "non_controversial_count", "controversial_count"),
)


def _sides(counts: DataFrame) -> DataFrame:
    """``(type, own_total, other_total)``: how many words each side has, in two rows."""
    totals = counts.agg(*[F.sum(own).alias(own) for _, own, _ in SIDES])
    rows = [x for label, own, other in SIDES for x in (F.lit(label), F.col(own), F.col(other))]
    return totals.select(F.stack(F.lit(len(SIDES)), *rows).alias("type", "own_total", "other_total"))


def _frequent(counts: DataFrame, candidates: int | None) -> DataFrame:
    """``(type, keyword, own, other)``: the words of each side, or its ``candidates`` most frequent ones."""
    parts = [
        (counts if candidates is None else counts.orderBy(F.desc(own), "word").limit(candidates))
        .select(F.lit(label).alias("type"), F.col("word").alias("keyword"), F.col(own).alias("own"), F.col(other).alias("other"))
        for label, own, other in SIDES
    ]
    return parts[0].unionByName(parts[1])


def rank_differential(
    counts: DataFrame, top_n: int = TOP_WORDS, candidates: int | None = None, min_count: int = MIN_COUNT
) -> DataFrame:
    """Words of each side by the ratio of their shares; nothing if one side has no words."""
    share = F.col("own").cast("double") / F.col("own_total")
    other_share = (F.col("other") + 1).cast("double") / (F.col("other_total") + 1)
    best_first = Window.partitionBy("type").orderBy(F.desc("score"), "keyword")
    return (
        _frequent(counts, candidates)
        .filter(F.col("own") >= min_count)
        # Two rows. A join rather than a scalar subquery: all readers of `counts` then share its shuffle.
        .join(F.broadcast(_sides(counts)), "type")
        .filter(F.col("other_total") > 0)
        .select("type", "keyword", (share / other_share).alias("score"))
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= top_n)
        .select("type", "rank", "keyword", "score")
    )


def differential_keywords(
    df: DataFrame,
    text_column: str = "body",
    sample_size: int | None = None,
    top_n: int = TOP_WORDS,
    keys: DataFrame | None = None,
    candidates: int | None = None,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Telling words of both sides, from all comments, or from up to ``sample_size`` of each side.

    ``keys`` may be a narrow table of the same comments for the sampling, see ``stratified_sample``.
    ``candidates`` limits the ranking to the most frequent words of a side.
    """
    rows = df if sample_size is None else stratified_sample(df, sample_size, keys=keys)
    return rank_differential(word_counts_by_side(rows, text_column), top_n, candidates, min_count)


def keyword_comparison(differential: DataFrame, per_type: int = EXPORT_WORDS) -> DataFrame:
    """Best words of both sides in one table."""
    return differential.filter(F.col("rank") <= per_type).select("type", "keyword", "score")
