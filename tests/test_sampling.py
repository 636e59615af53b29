import hashlib

from pyspark.sql import functions as F

from parley.operators import sampling


def comments(spark, flagged, others):
    flag = F.when(F.col("id") < flagged, 1)
    return spark.range(flagged + others).select("id", flag.alias("controversiality"))


def by_hash(ids, seed, n):
    return set(sorted(ids, key=lambda i: (hashlib.md5(f"{i}{seed}".encode()).hexdigest(), i))[:n])


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_stratified_sample_takes_equal_caps(spark):
    got = ids(sampling.stratified_sample(comments(spark, 5, 100), 30))
    assert len(got) == len(set(got)) == 35
    assert {i for i in got if i < 5} == set(range(5))
    assert {i for i in got if i >= 5} == by_hash(range(5, 105), 42, 30)


def test_sample_n_is_exact_and_repeatable(spark):
    df = comments(spark, 0, 2000)
    got = ids(sampling.sample_n(df, 700, seed=7))
    assert set(got) == by_hash(range(2000), 7, 700) and len(got) == 700
    assert set(ids(sampling.sample_n(df.repartition(5), 700, seed=7))) == set(got)
    assert len(ids(sampling.sample_n(df, 5000))) == 2000


def test_first_n_with_extreme_ids(spark):
    values = [-(2**63), -5, -1, 0, 1, 65_535, 65_536, 65_537, 2**40, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "id long")
    for n in (1, 2, 4, 6, 7, 10, 11, 20):
        assert sorted(ids(sampling.first_n(df, n))) == values[:n]
