"""Exact deduplication by distributed MSD radix partitioning.

All texts begin in one group. Every round splits each group by the next bytes of its texts, until a
group has one text or its texts have ended; texts that end together are equal byte for byte, so
equality needs no digest. A group is split by an aggregate over (group, bytes), which combines copies
before the shuffle, and the rows learn their new group by a join in which Spark can cut a hot group. The bytes
read per round grow fourfold: the number of rounds follows the logarithm of the longest text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.storage import dropped, written

SPACES = r"[\x20\x09-\x0D]+"
FIRST_BYTES = 64
GROWTH = 4


def normal_form(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame,
    key: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] | None = None,
    first_bytes: int = FIRST_BYTES,
) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, with ``keep_id``, ``group_size`` and ``kept``.

    ``key`` is the text that decides about equality (default: ``normal_form`` of ``text_column``). Of
    equal texts the row with the smallest id stays; null ids come last. Where rows share that id too,
    exactly one of them stays. An empty or null text equals any other. Input columns may have
    any name; the three new ones replace columns of the same name. An empty table gives an empty result.
    """
    new = ("keep_id", "group_size", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if id_column not in keep:
        raise ValueError(f"keep has to hold {id_column}")
    key = normal_form(F.col(text_column)) if key is None else key
    # All columns travel in one struct, so that none can clash with those of the algorithm.
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.lit(0).cast("bigint").alias("cell"),
        F.encode(key, "UTF-8").alias("rest"),
    )
    row_id, width, settled, last = F.col("row")[id_column], first_bytes, [], None
    while True:
        piece = F.substring(F.col("rest"), 1, width)
        pieces = rows.withColumn("piece", piece)
        cells = (
            pieces.groupBy("cell", "piece")
            .agg(F.min(F.struct(row_id.isNull(), row_id.alias("id"))).alias("first"), F.count("*").alias("n"))
            .filter(F.col("n") > 1)
            .select("cell", "piece", F.monotonically_increasing_id().alias("next"), F.col("first.id").alias("keep_id"), "n")
        )
        cells = written(cells, "radix-cells")
        shared = F.col("next").isNotNull() & (F.length("piece") == width)
        split = pieces.join(cells.hint("shuffle_hash"), ["cell", "piece"], "left").select(
            "row",
            F.col("next").alias("cell"),
            F.when(shared, F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
            F.when(F.col("next").isNull(), row_id).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            shared.alias("open"),
        )
        split = written(split, "radix-rows")
        dropped(docs.sparkSession, cells)
        settled.append(split.filter(~F.col("open")).drop("rest", "open"))
        rows = split.filter("open").select("row", "cell", "rest")
        if rows.isEmpty():
            break
        width *= GROWTH
    # A cell number is unique within a round only.
    parts = [part.withColumn("round", F.lit(k)) for k, part in enumerate(settled)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = row_id.eqNullSafe(F.col("keep_id"))
    tied = Window.partitionBy("round", "cell").orderBy(F.monotonically_increasing_id())
    alone = every.filter(F.col("group_size") == 1).withColumn("kept", F.lit(True))
    later = every.filter((F.col("group_size") > 1) & ~first).withColumn("kept", F.lit(False))
    firsts = every.filter((F.col("group_size") > 1) & first).withColumn("kept", F.row_number().over(tied) == 1)
    result = alone.unionByName(later).unionByName(firsts)
    return result.select(*[F.col("row")[c].alias(c) for c in keep], *new)


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with the columns they had."""
    return exact_dedup(docs, id_column=id_column, text_column=text_column).filter("kept").select(*docs.columns)
