import pytest

from parley.sources.comments import load_comments
from pyspark.sql import functions as F

from parley.operators.filters import analysis_rows
from parley.plans.report import build_report, write_report
from parley.sources import comments as src
from parley.sources.sinks import write_table


@pytest.fixture
def csv(spark, tmp_path):
    def write(text, name="in.csv"):
        path = tmp_path / name
        path.write_bytes(text.encode("utf-8"))
        return src.read_csv(spark, str(path))

    return write


def test_csv_quoting_newlines_bom_and_backslash(csv):
    df = csv('\ufeffsubreddit,body,score\na,"one\r\ntwo, ""three"" \\n",1\nb,plain \\ text,2\n')
    assert [tuple(r) for r in df.orderBy("score").collect()] == [
        ("a", 'one\r\ntwo, "three" \\n', "1"), ("b", "plain \\ text", "2"),
    ]


def test_csv_null_strings(csv):
    df = csv('id,body\n1,NA\n2,null\n3,\n4,""\n5,"N/A"\n6,nada\n')
    assert [r["body"] for r in df.orderBy("id").collect()] == [None] * 5 + ["nada"]


def test_normalize_aliases_and_case(spark):
    df = spark.createDataFrame([("t", 3, "2019", "me", "r")], "Selftext string, UPS int, Created_UTC string, User string, SR string")
    assert src.normalize_columns(df).columns == ["text", "score", "timestamp", "author", "subreddit", "id"]


def test_normalize_keeps_the_first_of_two_aliases(spark):
    df = spark.createDataFrame([("c", "b", 1, 2)], "comment string, body string, points int, ups int")
    row = src.normalize_columns(df).first()
    assert (row["text"], row["score"]) == ("b", 2)
    named = spark.createDataFrame([("t", "b")], "text string, body string")
    assert src.normalize_columns(named).first()["text"] == "t"


def test_normalize_falls_back_for_the_text_and_fills_defaults(spark):
    hinted = spark.createDataFrame([(1, "words")], "n int, my_comment_2 string")
    assert src.normalize_columns(hinted).first()["text"] == "words"
    first = spark.createDataFrame([(7, "x")], "n int, other string")
    row = src.normalize_columns(first).first()
    assert (row["text"], row["subreddit"], row["score"]) == ("7", "unknown", 0)
    many = src.normalize_columns(spark.range(50).select(F.col("id").alias("n")).repartition(4))
    assert many.select("id").distinct().count() == 50
    assert row["timestamp"] is not None


def test_typed_values(spark):
    df = spark.createDataFrame(
        [("9007199254740993", "1.0", "-3", "1556668800"), ("2", None, None, "2019-05-01 00:00:00")],
        "id string, controversiality string, score string, timestamp string",
    )
    rows = src.typed(df).orderBy("id").collect()
    assert [r["id"] for r in rows] == [2, 9007199254740993]
    assert [(r["controversiality"], r["score"]) for r in rows] == [(None, None), (1, -3)]
    assert len({r["timestamp"] for r in rows}) == 1
    assert dict(src.typed(df, id_type="string").dtypes)["id"] == "string"


def test_missing_columns_stop_the_report(spark):
    df = spark.createDataFrame([("t", "a")], "text string, subreddit string")
    with pytest.raises(ValueError, match="controversiality, score"):
        build_report(df)


def test_load_job(spark, tmp_path):
    rows = "".join(f"{i},r{i % 3},alpha beta gamma delta{i},{i},0\n" for i in range(60))
    path = tmp_path / "c.csv"
    path.write_text("id,sub,comment,points,controversiality\n" + rows + "61,r1,NA,100,0\n62,r1,the of and it is,100,0\n")
    load = lambda **kw: src.load_comments(spark, str(path), **kw)
    assert load().count() == 60
    assert load(subreddits=["r1"], min_score=30).count() == 10
    assert sorted(r["id"] for r in load(num_comments=5, random_sample=False).collect()) == [0, 1, 2, 3, 4]
    once = {r["id"] for r in load(num_comments=20, seed=3).collect()}
    assert once == {r["id"] for r in load(num_comments=20, seed=3).collect()} and 18 <= len(once) <= 20
    assert {"text", "clean_text", "tokens", "token_count", "timestamp"} <= set(load().columns)
    raw = load(profile="raw")
    assert raw.count() == 62 and "comment" in raw.columns


def test_round_trip_keeps_text(spark, tmp_path):
    texts = [" outer blanks ", 'say "hi", ok', "two\nlines", "back\\slash", "tab\tin", "naïve 漢字", "carriage\r\nreturn"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    write_table(df, str(tmp_path / "out"))
    back = src.read_csv(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [r["body"] for r in back] == texts


def test_report_tables_have_the_known_schemas(spark, tmp_path):
    body = "alpha beta gamma delta epsilon " * 2
    rows = [(i, body, "a" if i % 2 else "b", i % 3 // 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, subreddit string, controversiality int, score long")
    report = build_report(df)
    types = {name: table.dtypes for name, table in report.items()}
    assert types == {
        "tfidf_keywords": [("subreddit", "string"), ("rank", "int"), ("keyword", "string"), ("tfidf_score", "double")],
        "controversy_stats": [("Metric", "string"), ("Value", "string")],
        "subreddit_controversy_rates": [("subreddit", "string"), ("controversy_rate", "double")],
        "keyword_comparison": [("type", "string"), ("keyword", "string"), ("score", "double")],
    }
    write_report(report, str(tmp_path / "csv"))
    write_report(report, str(tmp_path / "parquet"), "parquet")
    for name, table in report.items():
        count = table.count()
        assert count > 0
        assert spark.read.parquet(str(tmp_path / "parquet" / name)).count() == count
        assert spark.read.csv(str(tmp_path / "csv" / name), header=True).columns == table.columns
    assert report["controversy_stats"].count() == 8
    for name, table in build_report(df, stage=True).items():
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, report[name].collect()))
    assert analysis_rows(src.with_body(df)).count() == 60


def test_csv_files_with_columns_in_another_order_are_not_misread(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body,score\n1,first text,3\n")
    (tmp_path / "b.csv").write_text("body,id,score\nother text,9,4\n")
    with pytest.raises(Exception, match="header"):
        load_comments(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], profile="raw").collect()
