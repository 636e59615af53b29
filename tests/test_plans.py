"""What the plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from parley.operators import controversy, filters, keywords, wordpass
from parley.plans.report import build_report
from parley.plans.tables import comments

PYTHON_ALLOWED = {"near_dup_candidates", "near_dup_pairs", "folded_comments", "opinion_clusters", "opinion_clusters_hierarchical"}
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
EAGER = PYTHON_ALLOWED | set(
    "csv_round_trip load_csv_comments load_metrics published_rates hot_ngrams hot_ngrams_demo near_dup_members "
    "stream_window_counts stream_bursts".split()
)
EAGER |= {q for q in QUERIES if q.startswith(("folded_", "report_"))}


def plans(df):
    """Optimized and executed plan, without the word lists."""
    execution = df._jdf.queryExecution()
    text = execution.optimizedPlan().toString(), execution.executedPlan().toString()
    return [re.sub(r"INSET .*?(yourselves|youve|yw)\b", "INSET", t) for t in text]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_python_no_cartesian_no_double_text_work(spark, small, name):
    optimized, executed = plans(QUERIES[name](spark, small))
    assert "EvalPython" not in executed and "InPandas" not in executed and "InArrow" not in executed
    assert "CartesianProduct" not in executed and "BroadcastNestedLoopJoin" not in executed
    # A filter that holds a text expression means the optimizer copied the work.
    filters_ = [line for line in optimized.splitlines() if re.match(r"[ :+*()0-9-]*Filter ", line)]
    assert not [f for f in filters_ if "regexp_extract_all" in f or "regexp_replace" in f]


def test_keywords_read_and_shuffle_the_words_once(spark, small):
    df = keywords.compute_tfidf(comments(spark, small, "body", "subreddit"))
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString()
    # The count table has four readers: one computes it, three reuse its shuffle.
    assert executed.count("ReusedExchange [subreddit#") >= 3
    assert "WindowGroupLimit" in executed


def test_the_report_reads_the_texts_once(spark, small):
    counted = wordpass.word_pass(comments(spark, small, "body", "subreddit", "controversiality", "score"))
    optimized, executed = plans(counted)
    assert optimized.count("regexp_extract_all") == 1
    assert sum("text:string" in schema for schema in re.findall(r"ReadSchema: struct<(.*?)>", executed)) == 1
    report = build_report(comments(spark, small, "body", "subreddit", "controversiality", "score"), stage=True)
    for table in report.values():
        assert "text:string" not in plans(table)[1] and "documents" not in "".join(table.inputFiles())


def test_the_null_check_reaches_the_scan(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    executed = plans(filters.analysis_rows(comments(spark, small, "body", "subreddit")))[1]
    assert re.search(r"PushedFilters: \[[^]]*IsNotNull\(source\)", executed)


def test_top_k_is_not_a_global_sort(spark, small):
    df = controversy.top_controversial(comments(spark, small, "subreddit", "controversiality"))
    assert "TakeOrderedAndProject" in plans(df)[1]


def test_only_needed_columns_are_read(spark, small):
    executed = plans(filters.with_min_score(comments(spark, small, "id", "score"), 3))[1]
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", executed)
    assert sorted(schemas) == ["doc_id:bigint", "event_id:bigint,value:double"]


def test_simple_filters_reach_the_scan(spark, small):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{small}/documents.parquet").select(F.col("source").alias("subreddit"), "doc_id")
    executed = plans(filters.of_subreddit(df, "src3"))[1]
    assert "EqualTo(source,src3)" in executed
