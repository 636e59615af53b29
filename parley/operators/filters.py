"""Row filters and the preprocessing of the load job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import CleanOptions
from parley.functions.text import clean_again, clean_text, split_tokens, staged

# Fixed value: a comment whose text was taken down.
TAKEN_DOWN = r"(?d)^\[deleted\]$|^\[removed\]$"


def in_subreddits(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.filter(F.col("subreddit").isin(list(names)))


def of_subreddit(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("subreddit") == name)


def with_min_score(df: DataFrame, minimum: int) -> DataFrame:
    return df.filter(F.col("score") >= minimum)


def valid_text(df: DataFrame, options: CleanOptions = CleanOptions(), text: str = "text") -> DataFrame:
    """Comments with a usable text: present, within the length limits, not taken down.

    Null text fails the length test, so the null and empty checks need no pass of their own.
    """
    body = F.col(text)
    in_limits = F.length(body) >= max(options.min_length, 1)
    if options.max_length is not None:
        in_limits = in_limits & (F.length(body) <= options.max_length)
    return df.filter(in_limits & ~body.rlike(TAKEN_DOWN))


def analysis_rows(df: DataFrame, text: str = "body", min_length: int = 10) -> DataFrame:
    """Rows the report works on: text and subreddit present, text long enough."""
    return df.filter(F.col("subreddit").isNotNull() & (F.length(text) >= min_length))


def is_analysis_row(text: str = "body", min_length: int = 10) -> Column:
    """The same as a flag that is never null."""
    return F.coalesce(F.col("subreddit").isNotNull() & (F.length(text) >= min_length), F.lit(False))


def is_controversial() -> Column:
    """True for flagged comments; anything else, null included, is on the other side."""
    return F.coalesce(F.col("controversiality") == 1, F.lit(False))


def controversy_split(df: DataFrame) -> DataFrame:
    """Label each comment with its side instead of scanning once per side."""
    return df.withColumn("is_controversial", is_controversial())


def preprocess(df: DataFrame, options: CleanOptions = CleanOptions(), text: str = "text") -> DataFrame:
    """Valid comments with ``clean_text``, ``tokens`` and ``token_count``; short ones dropped.

    Tokens come from a second cleaning of the clean text: removing one construct can uncover
    another, and the results depend on that second pass. Each costly step is computed once.
    """
    rows = valid_text(df, options, text)
    rows = staged(rows, "clean_text", clean_text(F.col(text), options))
    rows = staged(rows, "_recleaned", clean_again(F.col("clean_text")))
    rows = staged(rows, "tokens", split_tokens(F.col("_recleaned"), options)).drop("_recleaned")
    rows = rows.withColumn("token_count", F.size("tokens"))
    return rows.filter(F.col("token_count") >= options.min_tokens)
