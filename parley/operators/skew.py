"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 20_000  # a part holds at most 1/HOT_SHARE of the rows, so there are fewer hot keys than that
PART_ROWS = 10_000  # nor is a key with fewer rows than this cut


def salted_join(
    left: DataFrame, right: DataFrame, key: str | Sequence[str], counts: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """Join ``left``, whose keys may be hot, with ``right``, which has a few rows per key at most.

    A key with more rows than a part may hold is cut into as many parts as its count asks for, by a
    hash of the rows of ``left``, and repeated as often on the right. Only the hashes of such keys are
    broadcast; there are fewer than ``HOT_SHARE``. ``counts`` may give the rows per key as ``n``, else
    they are counted, which reads ``left`` once more. ``how`` is ``inner`` or ``left``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    part_rows = F.greatest(counts.agg(F.sum("n")).scalar() / HOT_SHARE, F.lit(float(PART_ROWS)))
    hashed = F.xxhash64(*keys)
    hot = counts.filter(F.col("n") > part_rows).select(
        hashed.alias("_hot"), F.ceil(F.col("n") / part_rows).cast("int").alias("_parts")
    )
    hot = F.broadcast(hot.groupBy("_hot").agg(F.max("_parts").alias("_parts")))
    part = F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")
    salted = left.join(hot, hashed == F.col("_hot"), "left").withColumn("_salt", F.coalesce(part, F.lit(0)))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = right.join(hot, hashed == F.col("_hot"), "left").withColumn("_salt", F.explode(parts))
    unused = ("_hot", "_parts")
    return salted.drop(*unused).join(repeated.drop(*unused), [*keys, "_salt"], how).drop("_salt")
