"""Lines that many documents share are removed; built-in expressions only.

Texts are named by their digest, so copies of a text are merged before their lines are exploded. Lines are hashed in normal
form, the documents of each hash are counted, the positions of lines above the limit come back to their text by a join, and
the other lines are put together again in the order of their positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import staged
from parley.operators.skew import salted_join
from parley.plans.storage import shared_dir, written

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEW = ("kept_text", "n_lines", "n_dropped")


def _lower_ascii(text: Column) -> Column:
    """A-Z in lower case; a text of ASCII alone takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The lines of a text without ASCII white space at their ends and with A-Z in lower case."""
    bare = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))
    return F.transform(bare, _lower_ascii)


def _line_hash(key: Column, min_length: int) -> Column:
    """128 bits that name a line; null for a line too short to be dropped."""
    name = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    return F.when(F.length(key) >= min_length, name)


def _text_lines(docs: DataFrame, text: Column, min_length: int) -> DataFrame:
    """``(name, hashes, copies)`` of the different texts, the hashes in the order of the lines."""
    hashes = F.transform(line_keys(text), lambda key: _line_hash(key, min_length))
    rows = docs.select(F.md5(text).alias("name"), hashes.alias("hashes"))
    return rows.groupBy("name").agg(F.any_value("hashes").alias("hashes"), F.count("*").alias("copies"))


def _line_counts(texts: DataFrame) -> DataFrame:
    """``(a, b, documents, n)`` of every line hash: documents with it, and lines in the different texts."""
    ordered = staged(texts.select("copies", "hashes"), "_in_order", F.array_sort("hashes")).select("copies", "_in_order")
    # Equal lines of a text are neighbours in this order; the first of them counts its documents.
    lines = F.transform(
        "_in_order",
        lambda h, i: F.struct(
            h["a"].alias("a"), h["b"].alias("b"),
            ~F.coalesce(F.get(F.col("_in_order"), i - 1) == h, F.lit(False)).alias("first"),
        ),
    )
    spread = ordered.select("copies", F.inline(lines).alias("a", "b", "first")).filter("a is not null")
    return spread.groupBy("a", "b").agg(
        F.sum(F.when(F.col("first"), F.col("copies")).otherwise(0)).alias("documents"), F.count("*").alias("n")
    )


def drop_shared_lines(
    docs: DataFrame, min_documents: int = 10, min_length: int = 1, text_column: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default: all) of every row, with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``. A line whose normal form (see ``line_keys``) has ``min_length`` code points or more and stands in
    ``min_documents`` rows or more loses all its lines in all rows; the others stay, joined by ``\\n``. ``n_lines`` counts
    the lines before. A null or empty text has one empty line and gives an empty text, as does one that loses all
    lines. Every row is a document: repeated rows, or rows with equal or null ids, count each for itself. An empty
    table gives an empty result. Input columns may have any name; the three new ones replace columns of the same name.

    Lines and texts are told apart by 128 bits of their content.
    """
    shared_dir(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = written(_text_lines(docs, text, min_length), "text-lines")
    shared = _line_counts(texts).filter(F.col("documents") >= min_documents).select("a", "b", "n")
    shared = written(shared, "shared-lines")
    lines = texts.select("name", F.posexplode("hashes").alias("position", "_hash"))
    lines = lines.filter("_hash is not null").select("name", "position", "_hash.a", "_hash.b")
    dropped = salted_join(lines, shared.select("a", "b"), ["a", "b"], shared)
    dropped = dropped.groupBy("name").agg(F.collect_list("position").alias("dropped"))
    # All columns travel in one struct, so that none can clash with those used here.
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.md5(text).alias("name"), text.alias("text"))
    found = salted_join(rows, dropped, "name", texts.select("name", F.col("copies").alias("n")), "left")
    found = staged(found.select("row", "dropped", "text"), "lines", F.split("text", "\n", -1)).drop("text")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(places, "dropped"), lambda k: F.get("lines", k))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(left)
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return found.select(
        *[F.col("row")[c].alias(c) for c in keep],
        F.array_join(kept, "\n").alias("kept_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        n_dropped.cast("bigint").alias("n_dropped"),
    )
