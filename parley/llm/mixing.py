"""Mixing sources to target weights.

Words are added up per source, each source's target gives its rate, and every document is taken
floor(rate) times plus once more with the probability of the fraction, decided by a seeded hash of the document.
Each source uses the one of ``SEEDS`` seeds whose copies add up closest to its target, so that a few long documents
do not carry a small source away from it. DataFrame functions only. One row per source is all that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import staged
from parley.plans.storage import written

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times that a source may be repeated
SEED = 42
SEEDS = 32  # that a source may choose from
_DIGITS = 8  # hexadecimal digits of a digest that make one uniform number
_PER_DIGEST = 64 // _DIGITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all sizes. A target
    stops at ``most`` times its source's size, and what is over is shared by weight among the others
    until none is above. That end state gives every source ``min(level * weight, cap)`` with one level for
    all, so the capped sources are those that come first by cap / weight: running sums find the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.select(
        "source",
        F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"),
        (1 + (F.row_number().over(by_name) - 1) % 3).cast("double").alias("weight"),
    ).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if this source and all later ones were uncapped; the first source that fits sets it for them.
    levels = weighted.withColumn("level", left / weight_left)
    levels = levels.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def _digest(group: Column) -> Column:
    """64 hexadecimal digits for a document, the uniform numbers of ``_PER_DIGEST`` seeds."""
    names = [F.lit(str(SEED)), group.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("identity")]
    return F.sha2(F.concat_ws("|", *names), 256)


def _uniform(digest: Column, place: Column) -> Column:
    digits = F.substr(digest, place * _DIGITS + 1, F.lit(_DIGITS))
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    # Small enough targets are sent to every task; Spark sizes them and otherwise cuts hot sources of a join.
    renamed = targets.withColumnRenamed("source", "_source")
    joined = rows.join(renamed, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))


def source_choices(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, seed)`` from rows of ``(id, source, size, identity)``.

    The seed is the one whose extra copies add up closest to what the whole repetitions leave of the target, the
    lowest of equals. Sums of all seeds come from one pass, combined before they travel.
    """
    targets = source_targets(rows, most)
    drawn = staged(_with_targets(rows, targets), "digests", F.array(*[_digest(F.lit(g)) for g in range(-(-SEEDS // _PER_DIGEST))]))
    sums = []
    for seed in range(SEEDS):
        uniform = _uniform(F.col("digests")[seed // _PER_DIGEST], F.lit(seed % _PER_DIGEST))
        sums.append(F.sum(F.when(uniform < F.col("fraction"), F.col("size")).otherwise(F.lit(0))))
    totals = drawn.groupBy("source").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("fraction").alias("fraction"),
        F.array(*sums).alias("sums"),
    )
    wanted = F.col("fraction") * F.col("source_size")
    nearest = F.array_min(F.transform("sums", lambda x, k: F.struct(F.abs(x - wanted).alias("off"), k.alias("seed"))))
    return totals.select("source", "source_size", "target", nearest["seed"].alias("seed"))


def _with_copies(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """``rows`` of ``(id, source, size, identity)`` with what their source chose and their ``copies``."""
    joined = _with_targets(rows, choices)
    seed = F.col("seed")
    uniform = _uniform(_digest(F.floor(seed / _PER_DIGEST).cast("int")), seed % _PER_DIGEST)
    extra = (uniform < F.col("fraction")).cast("bigint")
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("bigint"))


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("identity"),
    )


def mix_plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
             most: int = MOST) -> DataFrame:
    """Per document: ``(id, source, size, source_size, target, taken)``.

    ``size`` counts words; a null or empty text has none and takes none. A null source is a source of its own.
    Repeated rows decide alike; null ids are told apart by their text. Other columns play no part.
    """
    rows = written(_sized(docs, id_column, text_column, source_column), "sizes")
    planned = _with_copies(rows, source_choices(rows, most))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select(F.col("id").alias(id_column), F.col("source"), "size", "source_size", "target", taken)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        most: int = MOST) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they had."""
    rows = written(_sized(docs, id_column, text_column, source_column), "sizes")
    choices = source_choices(rows, most)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    planned = _with_copies(_sized(docs, id_column, text_column, source_column, whole), choices).filter("copies > 0")
    repeated = planned.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
