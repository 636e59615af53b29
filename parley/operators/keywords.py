"""Keyword ranking per community.

Comments are read and split once. Words are counted by ``(subreddit, word)`` with a map-side combine,
so a community or a word with a third of all rows is spread like any other; totals, community
frequencies and the number of comments all derive from that count table.

The optimizer would undo this: a filter on ``word``, or a null check it infers for a join key, moves
below the aggregate, and the readers of the count table no longer share one shuffle. So the keys are
never null, and what a reader leaves out is decided on the counts (``_own``), not on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import keyword_words

MIN_WORD_COUNT = 5  # fixed value: words below it are counted but not ranked
COMMENT = ""  # the "word" every comment has once; no real word is empty


def _counted(df: DataFrame, words: Column, group_column: str) -> DataFrame:
    """``(subreddit, word, doc_count)`` with one extra word per comment, so that comments are counted too.

    A comment without a community counts as a comment but has no words to give.
    """
    own_words = F.when(F.col(group_column).isNotNull(), words)
    no_words = F.array().cast("array<string>")
    spread = df.select(
        F.coalesce(F.col(group_column), F.lit("")).alias("subreddit"),
        F.explode(F.concat(F.array(F.lit(COMMENT)), F.coalesce(own_words, no_words))).alias("_word"),
    ).select("subreddit", F.coalesce("_word", F.lit(COMMENT)).alias("word"))
    return spread.groupBy("subreddit", "word").agg(F.count("*").alias("doc_count"))


def _own() -> Column:
    """The count of a real word; zero for the comment marker."""
    return F.when(F.col("word") == COMMENT, 0).otherwise(F.col("doc_count"))


def _comments(counts: DataFrame) -> Column:
    marked = F.when(F.col("word") == COMMENT, F.col("doc_count"))
    return counts.agg(F.coalesce(F.sum(marked), F.lit(0)).cast("double")).scalar()


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("subreddit").agg(F.sum(_own()).alias("total"))


def _group_freq(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.count_if(_own() > 0).alias("group_count"))


def _distinct_words(text_column: str) -> Column:
    return F.array_distinct(keyword_words(F.col(text_column)))


def group_word_df(df: DataFrame, text_column: str = "body", group_column: str = "subreddit") -> DataFrame:
    """Number of comments of each community that contain the word."""
    return _counted(df, _distinct_words(text_column), group_column).filter(_own() > 0)


def group_word_total(df: DataFrame, text_column: str = "body", group_column: str = "subreddit") -> DataFrame:
    """Sum of the word counts of each community, rare words included."""
    return _totals(_counted(df, _distinct_words(text_column), group_column)).filter(F.col("total") > 0)


def word_group_freq(df: DataFrame, text_column: str = "body", group_column: str = "subreddit") -> DataFrame:
    """Number of communities that use the word."""
    return _group_freq(_counted(df, _distinct_words(text_column), group_column)).filter(F.col("group_count") > 0)


def _ranked(scored: DataFrame, score: str, word: str, top_n: int) -> DataFrame:
    """Best words per community; the planner keeps ``top_n`` per task before it shuffles."""
    best_first = Window.partitionBy("subreddit").orderBy(F.desc(score), word)
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top_n)


def compute_tfidf(
    df: DataFrame, text_column: str = "body", group_column: str = "subreddit", top_n: int = 20
) -> DataFrame:
    """Best keywords per community by (share of the community's words) x ln(comments / communities).

    Every comment counts in the numerator of the logarithm, the denominator counts communities.
    """
    return rank_tfidf(_counted(df, _distinct_words(text_column), group_column), top_n)


def rank_tfidf(counts: DataFrame, top_n: int = 20) -> DataFrame:
    """``compute_tfidf`` from ``(subreddit, word, doc_count)`` with the comments under the word ``COMMENT``."""
    share = F.col("doc_count").cast("double") / F.col("total")
    rarity = F.ln(_comments(counts) / F.col("group_count"))
    scored = (
        # Rare words are needed in the totals only, so the joins see the frequent ones alone.
        counts.filter(_own() >= MIN_WORD_COUNT)
        .join(_totals(counts), "subreddit")
        .join(_group_freq(counts), "word")
        .select("subreddit", F.col("word").alias("keyword"), (share * rarity).alias("_score"))
    )
    return _ranked(scored, "_score", "keyword", top_n).select(
        "subreddit", "rank", "keyword", F.round("_score", 6).alias("tfidf_score")
    )


def unique_vocabulary(
    df: DataFrame, text_column: str = "body", group_column: str = "subreddit", top_n: int = 20
) -> DataFrame:
    """Words far more frequent in a community than in all the others together.

    Ratio of the word's share in the community to its add-one smoothed share in the rest. Empty
    for a community that is alone.
    """
    return rank_vocabulary(_counted(df, keyword_words(F.col(text_column)), group_column), top_n)


def rank_vocabulary(counts: DataFrame, top_n: int = 20) -> DataFrame:
    """``unique_vocabulary`` from ``(subreddit, word, doc_count)``, the occurrences of each word."""
    everywhere = counts.groupBy("word").agg(F.sum(_own()).alias("_word_total"))
    all_words = counts.agg(F.sum(_own())).scalar()
    elsewhere = (F.col("_word_total") - F.col("doc_count") + 1).cast("double") / (all_words - F.col("total") + 1)
    share = F.col("doc_count").cast("double") / F.col("total")
    scored = (
        counts.filter(_own() >= MIN_WORD_COUNT)
        .join(_totals(counts), "subreddit")
        .filter(all_words > F.col("total"))
        .join(everywhere, "word")
        .select("subreddit", "word", (share / elsewhere).alias("_score"))
    )
    return _ranked(scored, "_score", "word", top_n).select(
        "subreddit", "rank", "word", F.round("_score", 6).alias("specificity_score")
    )


def top_keyword_groups(keywords: DataFrame, groups: int = 6, per_group: int = 10) -> DataFrame:
    """Leading keywords of the communities that have most of them."""
    sizes = keywords.groupBy("subreddit").agg(F.count("*").alias("keyword_count"))
    largest = sizes.orderBy(F.desc("keyword_count"), "subreddit").limit(groups)
    # `largest` has `groups` rows, whatever the input.
    return keywords.filter(F.col("rank") <= per_group).join(F.broadcast(largest), "subreddit")
