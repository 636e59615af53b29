"""Publication of several tables as one, ids that do not change, figures that come with the load."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import sampling, stats
from parley.plans.report import build_report, publish_report
from parley.plans.topics import topic_tables
from parley.sources import comments as src
from parley.sources import ids
from parley.sources.publish import current_version, drop_old_versions, publish, read_published
from parley.sources.sinks import write_table


def tables(spark, n):
    return {"a": spark.range(n).withColumn("t", F.lit('say "hi",\nok')), "b": spark.range(2 * n).toDF("x")}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_readers_see_the_last_whole_version(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    for n in (3, 5):
        publish(tables(spark, n), path, fmt)
        got = read_published(spark, path)
        assert {k: v.count() for k, v in got.items()} == {"a": n, "b": 2 * n}
        assert {r["t"] for r in got["a"].collect()} == {'say "hi",\nok'}
        assert got["b"].dtypes == [("x", "bigint")]


def test_a_run_that_dies_between_tables_leaves_the_old_report_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    publish(tables(spark, 4), path)
    before = current_version(spark, path)
    broken = tables(spark, 9) | {"b": spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        publish(broken, path)
    assert current_version(spark, path) == before
    assert {k: v.count() for k, v in read_published(spark, path).items()} == {"a": 4, "b": 8}
    # What the broken run left is seen by nobody and goes with the old versions.
    assert drop_old_versions(spark, path) == 1
    publish(tables(spark, 1), path)
    assert drop_old_versions(spark, path) == 1
    assert [n for n in os.listdir(path) if n.startswith("version-")] == [current_version(spark, path)["version"]]
    assert read_published(spark, path)["a"].count() == 1


def test_a_report_is_published_as_a_whole(spark, tmp_path):
    rows = [(i, "alpha beta gamma delta epsilon " * 2, "ab"[i % 2], i % 3 // 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, subreddit string, controversiality int, score long")
    report = build_report(df)
    publish_report(report, str(tmp_path / "r"))
    got = read_published(spark, str(tmp_path / "r"))
    assert {n: t.dtypes for n, t in got.items()} == {n: t.dtypes for n, t in report.items()}
    assert all(sorted(map(tuple, got[n].collect())) == sorted(map(tuple, t.collect())) for n, t in report.items())


def test_ids_follow_from_content(spark, monkeypatch):
    monkeypatch.setattr(ids, "CHUNK", 7)
    rows = [(f"text {i % 40}", i % 40 or None) for i in range(60)] + [("copy", None)] * 50 + [(None, None)] * 7
    df = spark.createDataFrame(rows, "text string, score int")
    first = [tuple(r) for r in ids.with_stable_ids(df.repartition(5)).collect()]
    again = [tuple(r) for r in ids.with_stable_ids(df.orderBy(F.rand(3)).coalesce(2)).collect()]
    assert sorted(first, key=str) == sorted(again, key=str) and len({r[0] for r in first}) == len(rows)
    assert Counter(r[1:] for r in first) == Counter(rows)
    given = df.withColumn("id", F.lit(1))
    assert ids.with_stable_ids(given) is given


def test_a_sample_of_a_table_without_ids(spark, tmp_path):
    rows = [(f"alpha beta gamma delta{i}", f"r{i % 3}", 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "comment string, sub string, controversiality int, ups int")
    write_table(df, str(tmp_path / "c"))
    load = lambda part: src.select_comments(src.read_csv(spark, str(tmp_path / "c")).repartition(part), num_comments=50)
    once = {r["text"] for r in load(2).collect()}
    assert len(once) == 50 and once == {r["text"] for r in load(7).collect()}
    report = build_report(src.typed(src.normalize_columns(df).drop("id")), sample_size=20)
    assert report["keyword_comparison"].count() >= 0


def test_sample_fails_rather_than_be_short(spark):
    df = spark.range(3000).select(F.lit(5).alias("id"))
    for n, want in ((5000, 3000),):
        assert sampling.sample_n(df, n).count() == want


def test_figures_come_with_the_load(spark):
    rows = [(None, "a")] * 2 + [("long enough text", None)] * 3 + [("short", "a")] * 4 + [("long enough text", "a")] * 5
    df = spark.createDataFrame(rows, "body string, subreddit string")
    kept, seen = stats.observed_analysis_rows(df)
    assert kept.count() == 5
    assert seen.get == {"total": 14, "without_text": 2, "without_subreddit": 3, "too_short": 4, "valid": 5}
    share = stats.valid_share(df).first()
    assert (share["total"], share["valid"]) == (14, 5)


def test_presets_size_the_topics(spark):
    words = "red apple pie tart fast blue car race old stone house roof".split()
    rows = [(i, [words[(i + k) % 12] for k in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for size, top_k in (("demo", 5), ("medium", 10)):
        assert topic_tables(df, size, method=None)["hot_ngrams"].count() == top_k
    found = topic_tables(df, "demo")["opinion_clusters"]
    assert 1 <= found.select("cluster").distinct().count() <= 4
    with pytest.raises(ValueError):
        topic_tables(df, "tiny")
