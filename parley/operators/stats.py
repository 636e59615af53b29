"""Counts and means per community."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parley.operators.filters import analysis_rows, is_analysis_row


def docs_per_group(df: DataFrame, group_column: str = "subreddit") -> DataFrame:
    return df.groupBy(group_column).agg(F.count("*").alias("doc_count"))


def distinct_subreddits(df: DataFrame) -> DataFrame:
    return df.select("subreddit").distinct()


def count_subreddits(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("subreddit").alias("subreddits"))


def valid_share(df: DataFrame, text: str = "body", min_length: int = 10) -> DataFrame:
    """How many rows the report can use, and their share in percent."""
    valid = is_analysis_row(text, min_length)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(valid).alias("valid"),
        (F.avg(valid.cast("double")) * 100).alias("valid_percent"),
    )


def observed_analysis_rows(df: DataFrame, text: str = "body", min_length: int = 10) -> tuple[DataFrame, Observation]:
    """The rows that the report can use, and figures that come along with the first job that reads all of them.

    ``total`` rows read; ``without_text``, ``without_subreddit`` and ``too_short`` are what the filters drop, in this order; ``valid``
    rows are left. No scan of their own: a job that stops early, as a limit does, leaves them incomplete.
    """
    absent, unnamed = F.col(text).isNull(), F.col("subreddit").isNull()
    valid = is_analysis_row(text, min_length)
    seen = Observation()
    watched = df.observe(
        seen,
        F.count("*").alias("total"),
        F.count_if(absent).alias("without_text"),
        F.count_if(~absent & unnamed).alias("without_subreddit"),
        F.count_if(~absent & ~unnamed & ~valid).alias("too_short"),
        F.count_if(valid).alias("valid"),
    )
    return analysis_rows(watched, text, min_length), seen


def subreddit_stats(df: DataFrame) -> DataFrame:
    """Size, score and token figures per community, rounded to two places, largest first.

    Needs ``token_count``, as left by the preprocessing.
    """
    stats = df.filter(F.col("subreddit").isNotNull()).groupBy("subreddit").agg(
        F.count("id").alias("count"),
        F.bround(F.avg("score"), 2).alias("avg_score"),
        F.sum("score").alias("total_score"),
        F.bround(F.avg("token_count"), 2).alias("avg_tokens"),
    )
    return stats.orderBy(F.desc("count"), "subreddit")
