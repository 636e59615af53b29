import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, differences

SQL = {n: s for n, s in entry.oracle_sql().items() if not re.match(r"op\d+_|pipeline$", n)}
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
NO_SQL = {"near_dup_candidates", "opinion_clusters", "opinion_clusters_hierarchical"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def test_every_query_has_sql_unless_it_cannot():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, small, duck, name):
    assert differences(QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"subreddit", "rank", "keyword", "tfidf_score"}


def test_keyword_table_invariants(spark):
    from parley.config import KEYWORD_STOP_WORDS

    rows = entry.queries()["tfidf_keywords"](spark, "/root/testdata/sf0.01").collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r["subreddit"], []).append((r["rank"], r["tfidf_score"], r["keyword"]))
    for ranked in by_group.values():
        ranked.sort()
        assert [r[0] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) <= 20
        assert all(a[1] >= b[1] for a, b in zip(ranked, ranked[1:]))
        assert all(w.isascii() and w.isalpha() and 3 <= len(w) <= 15 and w not in KEYWORD_STOP_WORDS for _, _, w in ranked)


def test_opinion_clusters(spark):
    from pyspark.sql import functions as F

    from parley.operators.clusters import opinion_clusters

    themes = ["red apple pie tart", "fast blue car race", "old stone house roof"]
    rows = [(i, [w for n, w in enumerate(themes[i % 3].split()) if n != i // 3 % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert opinion_clusters(df, k=3, min_size=61).count() == 0
    for method in ("kmeans", "hierarchical"):
        got = opinion_clusters(df, k=3, method=method)
        assert got.filter(F.col("size") < 3).count() == 0
        for cluster in {r["cluster"] for r in got.collect()}:
            members = got.filter(F.col("cluster") == cluster).orderBy("rank").collect()
            assert [r["rank"] for r in members] == list(range(1, len(members) + 1)) and len(members) <= 3
            assert [r["distance"] for r in members] == sorted(r["distance"] for r in members)
            assert len({r["id"] % 3 for r in members}) == 1


def test_cluster_distance_is_euclidean(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F

    from parley.operators.clusters import _squared_distance

    df = spark.createDataFrame([(Vectors.sparse(4, [1, 3], [2.0, 1.0]), [1.0, 0.5, 0.0, -1.0], 2.25)], ["v", "c", "n"])
    assert df.select(_squared_distance(F.col("v"), F.col("c"), F.col("n"))).first()[0] == pytest.approx(1 + 1.5**2 + 4)
