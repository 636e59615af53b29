"""Quality rules: text statistics, and lines that too many documents of a host share.

Lines are normalised and hashed, and the distinct texts of a host with each line are counted. Lines above the limits
are removed, and a document with too little left is rejected. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import staged
from parley.operators.skew import salted_join
from parley.plans.storage import written

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words


@dataclass(frozen=True)
class QualityLimits:
    """A line is boilerplate above both ``line_docs`` texts and ``line_share`` of its host's texts.

    A document needs ``least_words`` words, at most ``repeat_percent`` percent of them in repeated windows, and has to
    keep at least ``left_percent`` percent of its words when boilerplate lines go.
    """

    least_words: int = 20
    repeat_percent: int = 30
    line_docs: int = 20
    line_share: float = 0.01
    left_percent: int = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def normal_line(line: Column) -> Column:
    """Lower case, white space as single spaces, digits as 0: what counts as the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACES, " "), "[0-9]", "0"))


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the ``words`` of each row, reading a text's windows once.

    Only texts that repeat a window at all have theirs sorted; equal windows are then neighbours.
    """
    last = F.size("words") - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW)))
    rows = staged(rows, "windows", F.when(last > 0, windows).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = staged(rows, "placed", F.when(repeats, placed))
    placed = F.col("placed")
    beside = lambda p, j: (F.get(placed, j - 1)["h"] == p["h"]) | (F.get(placed, j + 1)["h"] == p["h"])
    twice = F.filter(placed, lambda p, j: F.coalesce(beside(p, j), F.lit(False)))
    rows = staged(rows, "starts", F.when(placed.isNotNull(), F.sort_array(F.transform(twice, lambda p: p["i"]))))
    starts = F.col("starts")
    covered = F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop("windows", "placed", "starts")


def text_statistics(rows: DataFrame) -> DataFrame:
    """Adds the five counts to rows with ``text`` (null: none of anything)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARACTERS, "") != "")
    rows = staged(rows, "words", _words(text))
    rows = staged(rows, "lines", lines)
    rows = _repeated_words(rows)
    return rows.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.translate(text, SPACE_CHARACTERS, "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        }
    ).drop("words")


def _frequent_lines(texts: DataFrame, limits: QualityLimits) -> DataFrame:
    """``(host, line, n)`` of the lines above both limits; ``texts`` has one row per text of a host."""
    per_host = texts.groupBy("host").agg(F.count("*").alias("host_texts"))
    lines = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limits.line_docs)
    sized = counts.join(per_host, "host")
    return sized.filter(F.col("n") > limits.line_share * F.col("host_texts")).drop("host_texts")


def quality_rules(
    docs: DataFrame,
    limits: QualityLimits = QualityLimits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, the counts, ``n_cut_lines``, ``n_cut_words``, ``base_failed``, ``kept``, ``cut`` and ``keep``.

    ``cut`` holds the hashes of the lines to remove, which ``without_lines`` takes. Equal texts of a host count once,
    so copies do not make their own lines boilerplate. A null host is a host of its own. Null and empty texts
    have no words and fail. Repeated rows are judged alike, each in a row of its own. Columns other than those named
    are not read, and ``keep`` columns travel in a struct, so no name can clash.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.struct(F.col(id_column), *[F.col(c) for c in keep if c != id_column]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(host_column).cast("string")), F.lit("")).alias("host"),
        F.xxhash64(text, F.lit(1)).alias("text_a"),
        F.xxhash64(F.lit(2), text).alias("text_b"),
        F.col(text_column).alias("text"),
    )
    rows = text_statistics(rows)
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), _word_count(x).alias("words")))
    rows = written(rows.withColumn("lines", hashed).drop("text"), "quality-rows")

    texts = rows.groupBy("host", "text_a", "text_b").agg(F.any_value("lines").alias("lines"))
    frequent = written(_frequent_lines(texts, limits), "frequent-lines")
    spread = texts.select("host", "text_a", "text_b", F.explode("lines").alias("x"))
    spread = spread.groupBy("host", "text_a", "text_b", F.col("x.line").alias("line")).agg(
        F.count("*").alias("times"), F.sum("x.words").alias("words")
    )
    hit = salted_join(spread, frequent.select("host", "line"), ["host", "line"], frequent)
    cuts = hit.groupBy("host", "text_a", "text_b").agg(
        F.sum("times").alias("n_cut_lines"), F.sum("words").alias("n_cut_words"), F.collect_list("line").alias("cut")
    )
    judged = rows.drop("lines").join(cuts, ["host", "text_a", "text_b"], "left")
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_cut_words")
    base_failed = (n < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * n)
    depleted = (100 * left < limits.left_percent * n) | (left < limits.least_words)
    judged = judged.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_cut_lines", "n_cut_words")})
    return judged.select(
        F.col("row")[id_column].alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~((F.col("n_cut_words") > 0) & depleted)).alias("kept"),
        "n_cut_lines",
        "n_cut_words",
        F.coalesce("cut", F.array().cast("array<bigint>")).alias("cut"),
        *[F.col("row")[c].alias(c) for c in keep if c != id_column],
    )


def without_lines(text: Column, cut: Column) -> Column:
    """``text`` without the lines whose hashes are in ``cut``."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(cut, F.xxhash64(normal_line(x))))
    return F.when(F.size(cut) > 0, F.array_join(kept, "\n")).otherwise(text)
