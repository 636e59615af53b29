import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import trends
from parley.streaming.bursts import BURSTS, stream_bursts
from parley.streaming.windows import closed_window_counts, with_open_windows


def day(n, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def test_hot_ngrams_by_hand(spark):
    rows = [(["red", "car", "red"],)] * 5 + [(["blue"],)] * 7 + [(["rare"],)] * 3
    df = spark.createDataFrame(rows, "tokens array<string>")
    got = {r["ngram"]: (r["total_count"], r["doc_count"]) for r in trends.hot_ngrams(df, top_k=20).collect()}
    assert got == {
        "red": (10, 5), "car": (5, 5), "red car": (5, 5), "car red": (5, 5), "red car red": (5, 5), "blue": (7, 7),
    }
    best = trends.hot_ngrams(df, top_k=1).first()
    assert (best["ngram"], best["weight"]) == ("red", pytest.approx(10 * 1.0986122887))
    plain = trends.hot_ngrams(df, top_k=20, use_tfidf=False).filter("ngram = 'blue'").first()
    assert plain["weight"] == 7.0
    assert "blue" not in {r[0] for r in trends.hot_ngrams(df, max_doc_freq_ratio=0.4).select("ngram").collect()}


def test_levels_keep_all_frequent_ngrams(spark):
    rng = random.Random(8)
    rows = [([rng.choice("aaaaaabbcdefghijklmnop") for _ in range(rng.randrange(12))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    total, docs = Counter(), Counter()
    for (tokens,) in rows:
        grams = [" ".join(tokens[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(tokens) - n + 1)]
        total.update(grams)
        docs.update(set(grams))
    got = {r["ngram"]: (r["total_count"], r["doc_count"]) for r in trends.ngram_counts(df, 1, 4, 6).collect()}
    assert got == {g: (total[g], n) for g, n in docs.items() if n >= 6} and any(g.count(" ") == 3 for g in got)
    assert {r["ngram"] for r in trends.ngram_counts(df, 2, 2, 6).collect()} == {g for g in got if g.count(" ") == 1}


def test_the_filter_spares_rows(spark):
    rows = [([f"own{i}", "hot", "topic", f"other{i}", f"more{i}"],) for i in range(50)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    words = trends.ngram_counts(df, 1, 1, 5)
    bits = trends._frequent_bits(words, 5)
    # Of four pairs per comment one has two frequent words; a bit that is set for another word may let a few more pass.
    assert 50 <= trends._spread_level(df, 2, bits).count() <= 52
    assert trends._spread_level(df, 2, None).count() == 200


def test_bursts_count_missing_windows_as_zero(spark):
    rows = [(day(0), "a")] * 2 + [(day(1), "b")] + [(day(2), "a")] * 2 + [(day(3), "a")] * 3 + [(day(3), "new")] * 9
    df = spark.createDataFrame(rows, "timestamp timestamp, key string")
    got = trends.bursts(trends.window_counts(df, F.col("key"))).collect()
    found = {(r["window_start"], r["key"]): (r["n"], round(r["baseline"], 6), round(r["ratio"], 6)) for r in got}
    # Day 2: (2 + 0) / 2 before it; day 3: (2 + 0 + 2) / 3 before it; "new" has no baseline.
    assert found == {
        (day(2, 0), "a"): (2, 1.0, 2.0),
        (day(3, 0), "a"): (3, round(4 / 3, 6), 2.25),
    }


def test_burst_words(spark):
    rows = [(day(0), "quiet game")] + [(day(1), "game game storm")] * 4
    df = spark.createDataFrame(rows, "timestamp timestamp, body string")
    got = [(r["word"], r["n"], r["ratio"]) for r in trends.burst_words(df).collect()]
    assert got == [("game", 4, 4.0)]


def test_stream_and_batch_agree_over_several_runs(spark, tmp_path):
    key = F.col("key")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "timestamp timestamp, key string"
    for n in range(4):
        rows = [(day(n, h), "ab"[h % 2]) for h in range(24)] + [(day(n, 5), "c")] * (n + 1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        closed_window_counts(spark.readStream.schema(schema).parquet(source), out, state, key)
        closed = spark.read.schema("window_start timestamp, key string, n bigint").parquet(out)
        batch = spark.read.schema(schema).parquet(source)
        whole = {tuple(r) for r in with_open_windows(closed, batch, key).collect()}
        assert whole == {tuple(r) for r in trends.window_counts(batch, key).collect()}
    assert closed.count() > 0
    assert closed.filter(F.col("window_start") >= F.lit(day(3, 0))).count() == 0


def test_no_window_closed_yet(spark, tmp_path):
    schema = "timestamp timestamp, key string"
    batch = spark.createDataFrame([(day(0), "a")], schema)
    closed = spark.createDataFrame([], "window_start timestamp, key string, n bigint")
    assert [tuple(r) for r in with_open_windows(closed, batch, F.col("key")).collect()] == [(day(0, 0), "a", 1)]


def test_streamed_bursts_equal_batch_over_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, rng, key = "timestamp timestamp, key string", random.Random(2), F.col("key")
    late = []
    for n in range(8):
        rows = [(day(n, h), rng.choice("abcde" if n % 3 else "ab")) for h in range(24) for _ in range(rng.randrange(4))]
        rows += [(day(n, 3), None)] * (n % 4) + [(day(n, 5), "new")] * (9 if n > 4 else 0)
        if n == 5:
            # Two days behind: their windows are closed, so a stream has to leave these out.
            late = [(day(2, 4), "a")] * 50
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        if n == 5:
            spark.createDataFrame(late, schema).write.mode("append").parquet(source + "-late")
            spark.read.parquet(source + "-late").write.mode("append").parquet(source)
        if n in (0, 1, 3, 5, 6, 7):
            # Every call is a restart: a new query goes on from the state that the last one left.
            stream = spark.readStream.schema(schema).parquet(source)
            stream_bursts(stream, out, state, key, day(0, 0), threshold=1.2)
    spark.createDataFrame([(day(9, 12), "end")], schema).write.mode("append").parquet(source)
    stream_bursts(spark.readStream.schema(schema).parquet(source), out, state, key, day(0, 0), threshold=1.2)
    on_time = spark.read.schema(schema).parquet(source).exceptAll(spark.createDataFrame(late, schema))
    want = trends.bursts(trends.window_counts(on_time, key), threshold=1.2).filter(F.col("window_start") < F.lit(day(9, 0)))
    order = lambda rows: sorted((r["window_start"], str(r["key"]), r["n"], round(r["baseline"], 9), round(r["ratio"], 9)) for r in rows)
    got = spark.read.schema(BURSTS).parquet(out).collect()
    assert order(got) == order(want.collect()) and len({r["key"] for r in got}) > 3


def test_no_burst_before_a_window_closes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "timestamp timestamp, key string"
    spark.createDataFrame([(day(0), "a"), (day(1), "a"), (day(1), "a")], schema).write.parquet(source)
    stream_bursts(spark.readStream.schema(schema).parquet(source), out, state, F.col("key"), day(0, 0), threshold=1.0)
    assert spark.read.schema(BURSTS).parquet(out).count() == 0
