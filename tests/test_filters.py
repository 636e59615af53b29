from pyspark.sql import functions as F

from parley.config import CleanOptions
from parley.operators import filters


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_valid_text_limits_and_taken_down(spark):
    texts = {
        1: "x" * 9, 2: "x" * 10, 3: "x" * 5000, 4: "x" * 5001, 5: None, 6: "",
        7: "[deleted]", 8: "[deleted]\n", 9: "[removed]\n", 10: "[deleted] by user",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    assert ids(filters.valid_text(df)) == [2, 3, 4, 10]
    assert ids(filters.valid_text(df, CleanOptions(max_length=5000))) == [2, 3, 10]
    assert ids(filters.valid_text(df, CleanOptions(min_length=0))) == [1, 2, 3, 4, 10]


def test_analysis_rows(spark):
    rows = [(1, "long enough text", "a"), (2, None, "a"), (3, "long enough text", None), (4, "short", "a")]
    df = spark.createDataFrame(rows, "id int, body string, subreddit string")
    assert ids(filters.analysis_rows(df)) == [1]


def test_simple_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", -1), (3, "c", 0)], "id int, subreddit string, score long")
    assert ids(filters.in_subreddits(df, ["a", "c"])) == [1, 3]
    assert ids(filters.of_subreddit(df, "b")) == [2]
    assert ids(filters.with_min_score(df, 0)) == [1, 3]


def test_null_flag_is_on_the_other_side(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 2)], "id int, controversiality int")
    assert ids(filters.controversy_split(df).filter("is_controversial")) == [1]


def test_preprocess(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "the and of it was"), (3, "[deleted] by user"), (4, "tiny")]
    df = spark.createDataFrame(rows, "id int, text string")
    kept = filters.preprocess(df).collect()
    assert [(r["id"], r["clean_text"], r["tokens"], r["token_count"]) for r in kept] == [
        (1, "alpha beta gamma delta", ["alpha", "beta", "gamma", "delta"], 4)
    ]
    assert ids(filters.preprocess(df, CleanOptions(min_tokens=0)).filter(F.size("tokens") == 0)) == [2]
