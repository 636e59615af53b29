import pytest

from parley.operators import controversy, stats


def comments(spark, rows):
    return spark.createDataFrame(rows, "id long, subreddit string, body string, controversiality int, score long")


def test_rates_treat_null_flags_as_the_sides_do(spark):
    df = comments(spark, [(1, "a", "four", 1, 10), (2, "a", "sixsix", 0, 1), (3, "a", None, None, 2)])
    row = controversy.controversy_stats(df).first()
    assert (row.total_comments, row.controversial_count, row.non_controversial_count) == (3, 1, 2)
    assert row.controversy_rate == pytest.approx(100 / 3)
    assert (row.avg_length_controversial, row.avg_length_non_controversial) == (4.0, 6.0)
    assert (row.avg_score_controversial, row.avg_score_non_controversial) == (10.0, 1.5)
    rate = controversy.controversy_rate_by_subreddit(df).first()
    assert (rate.controversial, rate.total, rate.controversy_rate) == (1, 2, 50.0)


def test_stats_as_lines(spark):
    df = comments(spark, [(1, "a", "four", 1, 10), (2, "a", "sixsix", 0, 1)])
    lines = [(r["Metric"], r["Value"]) for r in controversy.stats_long(controversy.controversy_stats(df)).collect()]
    assert lines == [
        ("Total Comments", "2"), ("Controversial", "1"), ("Non-controversial", "1"), ("Controversy Rate (%)", "50.00"),
        ("Avg Length (Controversial)", "4.0"), ("Avg Length (Non-controversial)", "6.0"),
        ("Avg Score (Controversial)", "10.00"), ("Avg Score (Non-controversial)", "1.00"),
    ]


def test_no_rows_and_one_side(spark):
    empty = controversy.controversy_stats(comments(spark, [])).first()
    assert (empty.total_comments, empty.controversy_rate) == (0, None)
    one_side = comments(spark, [(i, "a", "game game", 0, 1) for i in range(20)])
    assert controversy.differential_keywords(one_side).count() == 0


def test_differential_keywords_by_hand(spark):
    hits = [(i, "a", "game game team", 1, 0) for i in range(10)]
    others = [(100 + i, "a", "team rare", 0, 0) for i in range(9)] + [(200, "a", "team", 0, 0)]
    got = {(r.type, r["rank"], r.keyword): r.score for r in controversy.differential_keywords(comments(spark, hits + others)).collect()}
    assert got == {
        ("controversial", 1, "game"): pytest.approx((20 / 30) / (1 / 20)),
        ("controversial", 2, "team"): pytest.approx((10 / 30) / (11 / 20)),
        ("non_controversial", 1, "team"): pytest.approx((10 / 19) / (11 / 31)),
    }


def test_candidates_are_taken_before_the_minimum_count(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "word" for i in range(310)]
    rows = [(i, "a", " ".join(words), i % 2, 0) for i in range(20)]
    assert controversy.differential_keywords(comments(spark, rows), top_n=400).filter("type = 'controversial'").count() == 310
    got = controversy.differential_keywords(comments(spark, rows), top_n=400, candidates=300)
    assert got.filter("type = 'controversial'").count() == 300
    assert got.filter("type = 'controversial'").orderBy("rank").first().keyword == "aaword"


def test_subreddit_stats(spark):
    rows = [(1, "a", 1, 3), (2, "a", 2, 4), (3, "b", 5, 5), (4, None, 5, 5)]
    df = spark.createDataFrame(rows, "id long, subreddit string, score long, token_count int")
    got = [tuple(r) for r in stats.subreddit_stats(df).collect()]
    assert got == [("a", 2, 1.5, 3, 3.5), ("b", 1, 5.0, 5, 5.0)]


def test_valid_share(spark):
    rows = [("long enough text", "a"), ("short", "a"), (None, "a"), ("long enough text", None)]
    df = spark.createDataFrame(rows, "body string, subreddit string")
    assert tuple(stats.valid_share(df).first()) == (4, 1, 25.0)
    assert stats.count_subreddits(df).first()[0] == 1
