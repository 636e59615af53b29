"""Ids for tables that have none, the same whenever they are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 10_000  # copies of a row that one task numbers at a time


def with_stable_ids(df: DataFrame, id_column: str = "id") -> DataFrame:
    """``df`` with an id from each row's content and, for rows that are equal in all columns, their number among them.

    Neither the order of the rows nor their partitions matter, so a second computation gives the same ids, and a sample by id
    the same rows. Equal rows are counted before the shuffle and spread again after it, in chunks if there are many. Ids are
    64-bit hashes: among n rows two agree with a probability below n^2 / 2^65.
    """
    columns = df.columns
    if id_column in columns:
        return df
    counted = df.groupBy(*[F.col(c) for c in columns]).agg(F.count("*").alias("_copies"))
    row_id = lambda number: F.xxhash64(number, *[F.col(c) for c in columns]).alias(id_column)
    few = counted.filter(F.col("_copies") <= CHUNK)
    few = few.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_number"))
    many = counted.filter(F.col("_copies") > CHUNK)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(CHUNK).cast("bigint")))
    many = many.select("*", starts.alias("_start")).repartition("_start", *columns)
    stop = F.least(F.col("_start") + CHUNK, F.col("_copies")) - 1
    many = many.select("*", F.explode(F.sequence("_start", stop)).alias("_number")).drop("_start")
    rows = few.unionByName(many)
    return rows.select(row_id(F.col("_number")), *columns)
