import math

import pytest
from pyspark.sql import functions as F

from parley.operators import keywords


def comments(spark, rows):
    return spark.createDataFrame(rows, "subreddit string, body string")


def test_document_frequency_counts_a_word_once_per_comment(spark):
    df = comments(spark, [("a", "game game team"), ("a", "game"), ("b", "team"), ("b", None), (None, "game")])
    got = {(r["subreddit"], r["word"]): r["doc_count"] for r in keywords.group_word_df(df).collect()}
    assert got == {("a", "game"): 2, ("a", "team"): 1, ("b", "team"): 1}
    assert {r["subreddit"]: r["total"] for r in keywords.group_word_total(df).collect()} == {"a": 3, "b": 1}
    assert {r["word"]: r["group_count"] for r in keywords.word_group_freq(df).collect()} == {"game": 1, "team": 2}


def test_tfidf_by_hand(spark):
    rows = [("a", "game")] * 5 + [("a", "team")] * 4 + [("b", "game")] * 6 + [("b", None), (None, "game"), ("c", "an of")]
    got = {(r["subreddit"], r["rank"], r["keyword"]): r["tfidf_score"] for r in keywords.compute_tfidf(comments(spark, rows)).collect()}
    n = len(rows)  # every row counts, the null body and the null community included
    assert got == {
        ("a", 1, "game"): pytest.approx(5 / 9 * math.log(n / 2), abs=1e-6),
        ("b", 1, "game"): pytest.approx(math.log(n / 2), abs=1e-6),
    }


def test_ties_go_by_word_and_top_n_holds(spark):
    rows = [("a", "zebra apple mango")] * 5
    got = [(r["rank"], r["keyword"]) for r in keywords.compute_tfidf(comments(spark, rows), top_n=2).collect()]
    assert sorted(got) == [(1, "apple"), (2, "mango")]


def test_other_column_names(spark):
    df = comments(spark, [("a", "game")] * 5).toDF("team", "note")
    got = keywords.compute_tfidf(df, text_column="note", group_column="team").first()
    assert (got["subreddit"], got["keyword"]) == ("a", "game")


def test_unique_vocabulary_by_hand(spark):
    rows = [("a", "game team")] * 5 + [("b", "team")] * 5
    got = {(r["subreddit"], r["rank"], r["word"]): r["specificity_score"] for r in keywords.unique_vocabulary(comments(spark, rows)).collect()}
    assert got == {
        ("a", 1, "game"): pytest.approx((5 / 10) / (1 / 6), abs=1e-6),
        ("a", 2, "team"): pytest.approx((5 / 10) / (6 / 6), abs=1e-6),
        ("b", 1, "team"): pytest.approx((5 / 5) / (6 / 11), abs=1e-6),
    }
    assert keywords.unique_vocabulary(comments(spark, rows[:5])).count() == 0


def test_hot_community_gives_the_same_counts(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("subreddit"), F.lit("game team").alias("body")
    )
    got = {(r["subreddit"], r["word"]): r["doc_count"] for r in keywords.group_word_df(hot).collect()}
    assert got == {("hot", "game"): 2000, ("hot", "team"): 2000, ("cold", "game"): 1000, ("cold", "team"): 1000}


def test_top_keyword_groups(spark):
    rows = [("a", r, f"w{r}", 1.0) for r in range(1, 13)] + [("b", 1, "w", 1.0), ("c", 1, "w", 1.0)]
    df = spark.createDataFrame(rows, "subreddit string, rank int, keyword string, tfidf_score double")
    got = keywords.top_keyword_groups(df, groups=2, per_group=10).collect()
    assert sorted((r["subreddit"], r["rank"]) for r in got) == [("a", r) for r in range(1, 11)] + [("b", 1)]
