import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.config import CleanOptions
from parley.functions import text as tx


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


CLEAN_CASES = [
    ("> a\nreal\n>b", "real"),
    ("|a|b|\nkeep | one", "keep one"),
    ("a :--: b", "a b"),
    ("**bold** and *it* x", "and x"),
    ("*spans\nlines* x", "x"),
    ("soooo aaaaaa end", "s end"),
    ("he exceeded it", "he e ed it"),
    ("&amp; &#x200b; &#39; x200b ok", "ok"),
    ("&gt; quoted", "quoted"),
    ("see http://a.b/c?d=e#f ok HTTPS://UP.com", "see f ok https up com"),
    ("x http://a.b/%20c!(d),e y", "x y"),
    ("hi @user_é1 and @müller", "hi and"),
    ("it's don't co-op", "it's don't co-op"),
    ("naïve café x", "na ve caf x"),
    ("line > not a quote", "line not a quote"),
    ("Tabs\tand blanks  fold", "tabs and blanks fold"),
    ("", ""),
    (None, ""),
]


def test_clean_text(spark):
    assert column(spark, [c[0] for c in CLEAN_CASES], tx.clean_text) == [c[1] for c in CLEAN_CASES]


def test_clean_text_options(spark):
    keep = CleanOptions(remove_urls=False, remove_mentions=False, lowercase=False)
    cleaned = column(spark, ["See http://a.b @Me"], lambda t: tx.clean_text(t, keep))
    assert cleaned == ["See http a b Me"]


def test_long_urls_do_not_exhaust_the_stack(spark):
    assert column(spark, ["x http://" + "a/b.c-" * 50_000 + " y"], tx.clean_text) == ["x y"]


def test_tokenize(spark):
    texts = ["the a 42 -- zzzzip zzzip word don't", "", None, "x yy 123 ab12 a-- ---"]
    assert column(spark, texts, tx.tokenize) == [["ip", "word"], [], [], ["yy", "ab12"]]
    plain = CleanOptions(remove_stopwords=False)
    assert column(spark, ["the a 42", ""], lambda t: tx.tokenize(t, plain)) == [["the", "a", "42"], []]


def test_second_cleaning(spark):
    # Removing one thing can uncover another: here a bare entity, a separator and a run.
    texts = ["x2&amp;0bb", "xx20éabc", "x20xaaaa1bc", "-&amp;- a", "a é-- - b", "aa@me aab", "c1 --b", "ccxabcdcc"]
    once = column(spark, texts, tx.clean_text)
    assert column(spark, once, tx.clean_again) == column(spark, once, tx.clean_text)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="axb0-' *|&;@>\né", max_size=40), min_size=20, max_size=60))
def test_second_cleaning_is_a_full_cleaning(spark, texts):
    once = column(spark, texts, tx.clean_text)
    assert column(spark, once, tx.clean_again) == column(spark, once, tx.clean_text)


def test_ngrams(spark):
    tokens = F.split(F.lit("a1 b1"), " ")
    row = spark.range(1).select(
        tx.ngrams(tokens, 2).alias("two"), tx.ngrams(tokens, 3).alias("three"), tx.ngram_range(tokens).alias("all")
    )
    assert row.first().asDict() == {"two": ["a1 b1"], "three": [], "all": ["a1", "b1", "a1 b1"]}


def test_shingles(spark):
    got = column(spark, ["abc", "", "aaabaaab", "abcde"], lambda t: F.array_sort(tx.split_shingles(t, 5)))
    assert got == [["abc"], [], ["aaaba", "aabaa", "abaaa", "baaab"], ["abcde"]]


def test_keyword_words(spark):
    texts = ["ab abc " + "x" * 15 + " " + "y" * 16, "café a_word it's fine", "The GAME game", "don't anyway", None]
    assert column(spark, texts, tx.keyword_words) == [
        ["abc", "x" * 15], ["fine"], ["game", "game"], ["anyway"], None,
    ]


def test_staged_column_is_computed_once(spark):
    df = tx.staged(spark.createDataFrame([("a b",)], "t string"), "c", tx.clean_text(F.col("t")))
    plan = df.filter(F.length("c") > 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t") == 1


@pytest.mark.parametrize("k", [1, 5])
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab c'-", max_size=30), min_size=1, max_size=5))
def test_shingles_are_all_pieces(spark, k, texts):
    expected = [sorted({t[i : i + k] for i in range(len(t) - k + 1)} or ({t} - {""})) for t in texts]
    assert column(spark, texts, lambda t: F.array_sort(tx.split_shingles(t, k))) == expected


def test_steps_are_skipped_only_where_they_change_nothing(spark):
    texts = ["a:--b > c", ">q\n@me ** x**", "&#38 &#x; &amp", "http:/a ://b https://c", "  a  .  b  ", "aaaa\n\n\n\nb", "|a|\n|b"]
    plain = lambda t: F.trim(tx.clean_text(t))
    needed, tx.NEEDED = tx.NEEDED, {}
    try:
        want = column(spark, texts, plain) + column(spark, texts, tx.clean_again)
    finally:
        tx.NEEDED = needed
    assert column(spark, texts, plain) + column(spark, texts, tx.clean_again) == want


def test_shingles_query_sorts_without_a_comparator(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["shingles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
