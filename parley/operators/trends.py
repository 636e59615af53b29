"""Hot topics and bursts over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import keyword_words, ngrams, staged
from parley.plans.storage import written


FILTER_CELLS = 1 << 17  # 64-bit cells of a level's filter: 1 MB, whatever the number of n-grams


def _bit_slot(ngram: Column) -> Column:
    """Place of an n-gram in a filter of ``64 * FILTER_CELLS`` bits."""
    return F.xxhash64(ngram).bitwiseAND(F.lit(64 * FILTER_CELLS - 1))


def _frequent_bits(counts: DataFrame, min_doc_freq: int) -> Column:
    """The filter of a level's frequent n-grams: a bit may be set for others too, never missing for them."""
    slot = _bit_slot(F.col("ngram"))
    cells = counts.filter(F.col("doc_count") >= min_doc_freq).select(F.shiftright(slot, 6).alias("cell"), slot.alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    found = cells.groupBy("cell").agg(F.bit_or(one).alias("bits")).toArrow()  # at most FILTER_CELLS rows
    bits = np.zeros(FILTER_CELLS, dtype="<i8")
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return F.lit(bits.tobytes())


def _is_set(bits: Column, ngram: Column) -> Column:
    slot = _bit_slot(ngram)
    byte = F.ascii(F.decode(F.substring(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.call_function("getbit", byte, slot.bitwiseAND(F.lit(7)).cast("int")) == 1


def _level_grams(rows: DataFrame, n: int, bits: Column | None) -> DataFrame:
    """``(_grams)``: the n-grams of every comment, sorted; with the level before's filter only those whose two shorter ones pass."""
    if bits is None:
        return staged(rows, "_grams", F.sort_array(ngrams(F.col("tokens"), n))).select("_grams")
    shorter = staged(rows, "_shorter", ngrams(F.col("tokens"), n - 1))
    passed = staged(shorter, "_passed", F.transform("_shorter", lambda g: _is_set(bits, g)))
    starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1)))
    both = F.filter(starts, lambda i: F.get(F.col("_passed"), i - 1) & F.get(F.col("_passed"), i))
    runs = F.transform(both, lambda i: F.array_join(F.slice("tokens", i, n), " "))
    return staged(passed, "_grams", F.sort_array(F.coalesce(runs, F.array().cast("array<string>")))).select("_grams")


def _spread_level(rows: DataFrame, n: int, bits: Column | None) -> DataFrame:
    """``(ngram, first)``: the n-grams are sorted, so the first of its kind is the one that differs from its predecessor."""
    flagged = F.transform(
        "_grams",
        lambda g, i: F.struct(
            g.alias("ngram"), F.coalesce(F.get(F.col("_grams"), i - 1) != g, F.lit(True)).alias("first")
        ),
    )
    return _level_grams(rows, n, bits).select(F.inline(flagged))


def ngram_counts(tokens: DataFrame, low: int, high: int, min_doc_freq: int) -> DataFrame:
    """``(ngram, total_count, doc_count)`` of all n-grams of ``low`` to ``high`` tokens in ``min_doc_freq`` comments or more.

    Level by level: an n-gram can be frequent only if the two shorter ones in it are, so from the second level on only
    n-grams whose parts pass the filter of the level before are spread and shuffled. ``tokens`` is a written table:
    every level reads it.
    """
    found, bits = [], None
    for n in range(1, high + 1):
        counts = _spread_level(tokens, n, bits).groupBy("ngram").agg(
            F.count("*").alias("total_count"), F.count_if("first").alias("doc_count")
        )
        counts = written(counts.filter(F.col("doc_count") >= min_doc_freq), "ngram-level")
        if n >= low:
            found.append(counts)
        if n < high:
            bits = _frequent_bits(counts, min_doc_freq)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def hot_ngrams(
    preprocessed: DataFrame,
    *,
    low: int = 1,
    high: int = 3,
    min_doc_freq: int = 5,
    max_doc_freq_ratio: float = 0.5,
    top_k: int = 10,
    use_tfidf: bool = True,
) -> DataFrame:
    """Topics by occurrences x ln(comments / comments with it), neither too rare nor everywhere.

    Takes ``tokens`` as left by the preprocessing, which are written once and read by every level.
    """
    tokens = written(preprocessed.select("tokens"), "ngram-tokens")
    counts = ngram_counts(tokens, low, high, min_doc_freq)
    comments = tokens.agg(F.count("*").cast("double")).scalar()
    weight = F.ln(comments / F.col("doc_count")) if use_tfidf else F.lit(1.0)
    return (
        counts.filter(F.col("doc_count") <= max_doc_freq_ratio * comments)
        .select("ngram", "total_count", "doc_count", (F.col("total_count") * weight).alias("weight"))
        .orderBy(F.desc("weight"), "ngram")
        .limit(top_k)
    )


def window_counts(df: DataFrame, key: Column, time_column: str = "timestamp", *, hours: int = 24) -> DataFrame:
    """``(window_start, key, n)``: rows per tumbling window and key; batch or stream."""
    counted = df.groupBy(F.window(time_column, f"{hours} hours").alias("_window"), key.alias("key"))
    return counted.agg(F.count("*").alias("n")).select(F.col("_window.start").alias("window_start"), "key", "n")


def bursts(counts: DataFrame, *, hours: int = 24, threshold: float = 2.0) -> DataFrame:
    """Windows in which a key is at least ``threshold`` times as frequent as before.

    The baseline is the mean count of all earlier windows of the table, a window without the key
    counting as zero; a key never seen before has no baseline. A key has one row per window at
    most, so ordering the rows of a key stays small however frequent it is.
    """
    first = counts.agg(F.min("window_start")).scalar()
    earlier = (F.unix_seconds("window_start") - F.unix_seconds(first)) / F.lit(hours * 3600)
    before = Window.partitionBy("key").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    baseline = F.sum("n").over(before).cast("double") / F.nullif(earlier, F.lit(0.0))
    return (
        counts.withColumn("baseline", baseline)
        .withColumn("ratio", F.col("n") / F.nullif("baseline", F.lit(0.0)))
        .filter(F.col("ratio") >= threshold)
    )


def spread_words(df: DataFrame, words: str = "words", time_column: str = "timestamp") -> DataFrame:
    """``(timestamp, word)`` from a column of word lists.

    The outer explode keeps the optimizer from testing the list first, which would build it twice.
    """
    rows = df.select(F.col(time_column).alias("timestamp"), F.explode_outer(words).alias("word"))
    return rows.filter(F.col("word").isNotNull())


def burst_words(df: DataFrame, text_column: str = "body", *, hours: int = 24, threshold: float = 2.0) -> DataFrame:
    """Words that suddenly appear in more comments than usual."""
    words = df.select("timestamp", F.array_distinct(keyword_words(F.col(text_column))).alias("words"))
    counts = window_counts(spread_words(words), F.col("word"), hours=hours)
    return bursts(counts, hours=hours, threshold=threshold).withColumnRenamed("key", "word")
