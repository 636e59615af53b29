"""Bounded tables of bits that keep most rows without a wanted key from being moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_BITS = 1 << 15  # bits of a cell: what one of Spark's bitmaps holds, 4 kB
MOST_CELLS = 1 << 13  # 32 MB are broadcast at most, whatever the number of keys


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame, n: int, bits: int = 16) -> DataFrame:
    """Rows whose ``key`` is among the ``n`` ones of ``wanted``, null included, and about one of ``bits`` others.

    No row of a wanted key is lost. The rows do not move: the table of bits is broadcast. Beyond ``MOST_CELLS * CELL_BITS /
    bits`` keys more of the others pass, so an exact step has to follow.
    """
    cells = 1
    while cells < MOST_CELLS and cells * CELL_BITS < n * bits:
        cells *= 2
    slot = F.xxhash64(key).bitwiseAND(F.lit(cells * CELL_BITS - 1))
    cell, place = F.shiftright(slot, 15).alias("_cell"), slot.bitwiseAND(F.lit(CELL_BITS - 1)).alias("_place")
    table = wanted.select(cell, place).repartition("_cell").groupBy("_cell").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.substring(F.col("_bits"), (F.shiftright(F.col("_place"), 3) + 1).cast("int"), F.lit(1))
    bit = F.call_function("getbit", F.ascii(F.decode(byte, "ISO-8859-1")), F.col("_place").bitwiseAND(F.lit(7)).cast("int"))
    return rows.select("*", cell, place).join(F.broadcast(table), "_cell").filter(bit == 1).select(*rows.columns)
