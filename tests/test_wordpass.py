"""Tables rolled up from one reading of the texts against the operators that read them each."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import controversy, keywords, wordpass
from parley.plans.storage import written

SCHEMA = "body string, subreddit string, controversiality int, score bigint"
VOCABULARY = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]


def random_rows():
    rng = random.Random(3)
    rows = [
        (" ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 40))), rng.choice(["a", "b", "c"]), rng.choice([0, 1, None]), rng.choice([1, 5, None]))
        for _ in range(300)
    ]
    return rows + [(None, "a", 1, 4), ("", "b", 0, 3), ("wordaa wordaa", None, 1, 2), ("wordaa " * 5000, "hot", 1, 1)]


def same(left, right):
    def rounded(df):
        columns = [F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string") for c, t in sorted(df.dtypes)]
        return sorted(map(repr, df.select(*columns).collect()))

    assert rounded(left) == rounded(right)


@pytest.fixture(scope="module", params=["rows", "empty"])
def both(request, spark):
    rows = spark.createDataFrame(random_rows() if request.param == "rows" else [], SCHEMA)
    return rows, written(wordpass.word_pass(rows), "test-words")


def test_keywords(both):
    rows, counted = both
    same(keywords.rank_tfidf(wordpass.comments_with_word(counted)), keywords.compute_tfidf(rows))


def test_vocabulary(both):
    rows, counted = both
    same(keywords.rank_vocabulary(wordpass.occurrences(counted)), keywords.unique_vocabulary(rows))


def test_words_by_side(both):
    rows, counted = both
    same(wordpass.words_by_side(counted), controversy.word_counts_by_side(rows))


def test_rates(both):
    rows, counted = both
    same(wordpass.rates(counted), controversy.controversy_rate_by_subreddit(rows))


def test_statistics(both):
    rows, counted = both
    # A null text has no length and takes no part in the mean; the report leaves such rows out before.
    rows, counted = rows.filter("body is not null"), wordpass.word_pass(rows.filter("body is not null"))
    same(wordpass.side_statistics(counted), controversy.controversy_stats(rows))


def test_no_score_column(spark):
    rows = spark.createDataFrame([("alpha beta gamma", "a", 1)], "body string, subreddit string, controversiality int")
    found = wordpass.side_statistics(wordpass.word_pass(rows)).first()
    assert found["total_comments"] == 1 and found["avg_score_controversial"] is None
