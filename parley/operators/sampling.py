"""Exact, repeatable samples in two scans, whatever their size.

The first scan reads ids only and finds the last row of the sample, the second filters the comments by it: they are never
shuffled or ranked. A random sample takes the rows with the smallest hashes. Hashes are uniform, so a bound on them that a
little more than ``n`` rows pass follows from the number of rows, and only those few are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.filters import is_controversial

HASH_DIGITS = 13  # hex digits of a hash that are compared as a number, exact in a double
SPREAD = 8.0  # standard deviations that the bound lies above n: missed with a probability below 1e-15


def hash_key(seed: int, id_column: str = "id") -> Column:
    """Pseudo-random sort key: the same rows win in every engine and on every run."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(str(seed))))


def _fraction(key: Column) -> Column:
    """The hash as a number from 0 to 1."""
    return F.conv(F.substr(key, F.lit(1), F.lit(HASH_DIGITS)), 16, 10).cast("double") / float(16**HASH_DIGITS)


def _bound(n: int, rows: Column) -> Column:
    """Fraction that the hashes of ``n`` rows stay below; above 1 where there are hardly more rows."""
    return (F.lit(float(n)) + SPREAD * n**0.5 + SPREAD * SPREAD) / F.greatest(rows, F.lit(1))


def _last(n: int, found: Column, rows: Column, last: Column) -> Column:
    """The last row of the sample, unless the bound was missed: a wrong sample is not returned."""
    missed = F.raise_error(F.lit("too many equal ids for a sample by their hashes"))
    return F.when(found < F.least(F.lit(n), rows), missed).otherwise(last)


def smallest_hashes(
    df: DataFrame, n: int, seed: int, stratum: Column, id_column: str = "id", keys: DataFrame | None = None
) -> DataFrame:
    """The ``n`` rows of every stratum with the smallest hashes of their ids, all rows of a smaller stratum.

    Ids must be unique; should so many be equal that the bound is missed, the query fails rather than return fewer rows.
    ``stratum`` takes a handful of values. ``keys`` may be a narrow table of the same rows for the first scan.
    """
    source = df if keys is None else keys
    key = hash_key(seed, id_column)
    narrow = source.select(stratum.alias("_stratum"), key.alias("_key"), F.col(id_column).alias("_id"))
    # One row per stratum.
    sizes = narrow.groupBy("_stratum").agg(F.count("*").alias("_rows"))
    few = narrow.join(F.broadcast(sizes), "_stratum").filter(_fraction(F.col("_key")) <= _bound(n, F.col("_rows")))
    in_order = Window.partitionBy("_stratum").orderBy("_key", "_id")
    first = few.withColumn("_rank", F.row_number().over(in_order)).filter(F.col("_rank") <= n)
    last = first.groupBy("_stratum").agg(
        F.max(F.struct("_key", "_id")).alias("_last"), F.count("*").alias("_found"), F.any_value("_rows").alias("_rows")
    )
    last = last.select("_stratum", _last(n, F.col("_found"), F.col("_rows"), F.col("_last")).alias("_last"))
    chosen = F.struct(key.alias("_key"), F.col(id_column).alias("_id")) <= F.col("_last")
    return df.withColumn("_stratum", stratum).join(F.broadcast(last), "_stratum").filter(chosen).drop("_stratum", "_last")


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` random comments (all of them if there are fewer)."""
    if n <= 0:
        return df.limit(0)
    key = hash_key(seed)
    narrow = df.select(key.alias("_key"), F.col("id").alias("_id"))
    rows = narrow.agg(F.count("*")).scalar()
    few = narrow.filter(_fraction(F.col("_key")) <= _bound(n, rows)).orderBy("_key", "_id").limit(n)
    found = few.agg(F.max(F.struct("_key", "_id")).alias("last"), F.count("*").alias("found"))
    last = found.select(_last(n, F.col("found"), rows, F.col("last"))).scalar()
    return df.filter(F.struct(key.alias("_key"), F.col("id").alias("_id")) <= last)


def stratified_sample(
    df: DataFrame, n: int = 50_000, seed: int = 42, keys: DataFrame | None = None
) -> DataFrame:
    """Up to ``n`` controversial and up to ``n`` other comments.

    ``keys`` may be a table of the same comments with ``id`` and ``controversiality`` only.
    """
    return smallest_hashes(df, n, seed, is_controversial(), keys=keys)


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` comments with the lowest ids (all of them if there are fewer).

    Spark's own top-k over the ids alone finds the last of them; a task passes on ``n`` ids at most.
    """
    if n <= 0:
        return df.limit(0)
    last = df.select("id").orderBy("id").limit(n).agg(F.max("id")).scalar()
    return df.filter(F.col("id") <= last)
