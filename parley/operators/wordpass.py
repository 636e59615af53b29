"""Everything the report counts, from one reading of the texts.

A comment gives one row per word it holds, and a few marker rows with its own figures. All are added up by
``(subreddit, controversial, word)`` with a map-side combine, so a community or a word with a third of all rows is spread
like any other. Every table of the report is a roll-up of that count table, which is far smaller than the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import comment_length, keyword_words, staged
from parley.operators.filters import is_controversial
from parley.operators.keywords import COMMENT

# Markers: no word has a space in it.
FLAG_SUM, FLAG_KNOWN, LENGTH_SUM, SCORE_SUM, SCORE_KNOWN = " flag", " flags", " length", " score", " scores"


def _entry(word: str, comments: int, weight: Column) -> Column:
    return F.struct(
        F.lit(word).alias("word"), F.lit(comments).alias("comments"), weight.cast("double").alias("weight")
    )


def word_pass(rows: DataFrame, text_column: str = "body") -> DataFrame:
    """``(subreddit, controversial, word, doc_count, weight)``: comments with the word, and its occurrences.

    The word ``""`` stands for the comments themselves. The other markers have their sums in ``weight``: flags,
    known flags, lengths, scores and known scores. Null and empty texts have no words but count as comments.
    A null community has rows of its own; as elsewhere, its comments count and its words belong to no community. A column ``score`` may be absent; others than those named are not read.
    """
    score = F.col("score") if "score" in rows.columns else F.lit(None)
    flag = F.col("controversiality")
    rows = rows.select(
        "subreddit",
        is_controversial().alias("controversial"),
        F.array(
            _entry(COMMENT, 1, F.lit(1)),
            _entry(FLAG_SUM, 0, flag),
            _entry(FLAG_KNOWN, 0, F.when(flag.isNotNull(), 1)),
            _entry(LENGTH_SUM, 0, comment_length(F.col(text_column))),
            _entry(SCORE_SUM, 0, score),
            _entry(SCORE_KNOWN, 0, F.when(score.isNotNull(), 1)),
        ).alias("figures"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    # Sorted, equal words are neighbours: the first of them counts the comment.
    rows = staged(rows, "words", F.sort_array(keyword_words(F.col("text"))))
    first = lambda w, i: F.coalesce(F.get("words", i - 1) != w, F.lit(True))
    words = F.transform(
        "words",
        lambda w, i: F.struct(w.alias("word"), first(w, i).cast("int").alias("comments"), F.lit(1.0).alias("weight")),
    )
    entries = rows.select("subreddit", "controversial", F.explode(F.concat("figures", words)).alias("x"))
    return entries.groupBy("subreddit", "controversial", F.col("x.word").alias("word")).agg(
        F.sum("x.comments").alias("doc_count"), F.coalesce(F.sum("x.weight"), F.lit(0.0)).alias("weight")
    )


def _no_figures(counted: DataFrame) -> DataFrame:
    return counted.filter(~F.col("word").isin(FLAG_SUM, FLAG_KNOWN, LENGTH_SUM, SCORE_SUM, SCORE_KNOWN))


def _by_community(counted: DataFrame, count: Column) -> DataFrame:
    known = _no_figures(counted).filter(F.col("subreddit").isNotNull() | (F.col("word") == COMMENT))
    keys = F.coalesce("subreddit", F.lit("")).alias("subreddit"), F.col("word")
    return known.groupBy(*keys).agg(count.alias("doc_count"))


def comments_with_word(counted: DataFrame) -> DataFrame:
    """``(subreddit, word, doc_count)`` as ``keywords.rank_tfidf`` takes it."""
    return _by_community(counted, F.sum("doc_count"))


def occurrences(counted: DataFrame) -> DataFrame:
    """``(subreddit, word, doc_count)`` with occurrences as counts, as ``keywords.rank_vocabulary`` takes it."""
    return _by_community(counted, F.sum("weight").cast("bigint"))


def words_by_side(counted: DataFrame) -> DataFrame:
    """``(word, controversial_count, non_controversial_count)`` as ``controversy.rank_differential`` takes it."""
    hit = F.col("controversial")
    words = _no_figures(counted).filter(F.col("word") != COMMENT)
    side = lambda on: F.coalesce(F.sum(F.when(on, F.col("weight"))), F.lit(0.0)).cast("bigint")
    return words.groupBy("word").agg(
        side(hit).alias("controversial_count"), side(~hit).alias("non_controversial_count")
    )


def _figure(word: str, on: Column | None = None) -> Column:
    wanted = F.col("word") == word if on is None else (F.col("word") == word) & on
    return F.coalesce(F.sum(F.when(wanted, F.col("weight"))), F.lit(0.0))


def side_statistics(counted: DataFrame) -> DataFrame:
    """One row: counts, rate, mean length and mean score of both sides, as ``controversy.controversy_stats``."""
    hit = F.col("controversial")
    total, hits = _figure(COMMENT), _figure(COMMENT, hit)
    mean = lambda sums, n, on: _figure(sums, on) / F.nullif(_figure(n, on), F.lit(0.0))
    return counted.agg(
        total.cast("bigint").alias("total_comments"),
        hits.cast("bigint").alias("controversial_count"),
        (total - hits).cast("bigint").alias("non_controversial_count"),
        (hits / F.nullif(total, F.lit(0.0)) * 100).alias("controversy_rate"),
        mean(LENGTH_SUM, COMMENT, hit).alias("avg_length_controversial"),
        mean(LENGTH_SUM, COMMENT, ~hit).alias("avg_length_non_controversial"),
        mean(SCORE_SUM, SCORE_KNOWN, hit).alias("avg_score_controversial"),
        mean(SCORE_SUM, SCORE_KNOWN, ~hit).alias("avg_score_non_controversial"),
    )


def rates(counted: DataFrame) -> DataFrame:
    """``(subreddit, controversial, total, controversy_rate)``, as ``controversy.controversy_rate_by_subreddit``."""
    per_group = counted.filter(F.col("subreddit").isNotNull()).groupBy("subreddit").agg(
        _figure(FLAG_SUM).cast("bigint").alias("controversial"), _figure(FLAG_KNOWN).cast("bigint").alias("total")
    )
    rate = F.col("controversial").cast("double") / F.nullif("total", F.lit(0)) * 100
    return per_group.withColumn("controversy_rate", rate)
