"""Substring deduplication: paragraphs that repeat across documents.

Paragraphs are the lines of a text that have enough words. MinHash bands, tuned for the wanted recall at the threshold,
bring similar paragraphs together; those that collide are compared exactly, and the components of the links
say what repeats. Of every component the first paragraph stays, the others are to be removed.

What repeats inside otherwise different lines, or across line ends, is found by pieces: of every ``WINDOW`` runs of
``PIECE`` words that begin one after the other, the one with the smallest hash is a piece. The choice depends on those words
only, so two texts with ``PIECE + WINDOW - 1`` = 50 equal words in a row have a piece of them in common, wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.ngram_join import key_components
from parley.llm.shingles import LOWER, bands_for, minhash_keys, mix, shingle_hashes, shingle_set
from parley.llm.wordtokens import text_groups
from parley.operators.skew import salted_join
from parley.plans.shipping import ship_package
from parley.plans.storage import shared_dir, written

LEAST_WORDS = 20
SHINGLE = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.99
PIECE = 25
WINDOW = 26
SCANNED = ("id", "place", "n_words", "node", "keys", "piece", "start", "last_place")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _paragraphs(text: bytes, least: int) -> list[tuple[int, bytes, int]]:
    """Number, line and words of the lines with at least ``least`` words."""
    found = []
    for place, line in enumerate(text.split(b"\n")):
        if len(line) >= 2 * least - 1 and (n := len(line.split())) >= least:
            found.append((place, line, n))
    return found


def _named(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _windowed(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The smallest or largest of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = best(x[:-done], x[done:]), 2 * done
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, put together from runs of 1, 2, 4 and so on."""
    powers = [mix(h + np.uint64(width))]
    while 2 << len(powers) <= 2 * width:
        x, step = powers[-1], 1 << (len(powers) - 1)
        powers.append(mix(x[:-step] * _MULTIPLIER + x[step:]))
    n, run, done = len(h) - width + 1, None, 0
    for k in reversed(range(len(powers))):
        if width >> k & 1:
            part = powers[k][done : done + n]
            run = part.copy() if run is None else mix(run * _MULTIPLIER + part)
            done += 1 << k
    return run


def _piece_starts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces of a text with these words, and the numbers of their first words."""
    if len(h) < PIECE + WINDOW - 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    runs = _runs(h, PIECE)
    smallest = _windowed(runs, WINDOW, np.minimum)
    # A run is a piece if it is the smallest of a window that it lies in; equal runs are so alike.
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    starts = np.flatnonzero(runs <= _windowed(np.concatenate([edge, smallest, edge]), WINDOW, np.maximum))
    return runs[starts].view(np.int64), starts


def _scanned(shingle: int, least: int, bands: int, rows: int):
    """One reading of the texts: a row per line with enough words, and a row per piece."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for first, texts in text_groups(batch, "text", 1 << 20):
                yield from _scanned_group(ids, first, texts, shingle, least, bands, rows)

    return scanned


def _scanned_group(
    ids: pa.Array, first: int, texts: list[bytes], shingle: int, least: int, bands: int, rows: int
) -> Iterator[pa.RecordBatch]:
    split = [[line.split() for line in text.translate(LOWER).split(b"\n")] for text in texts]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(chain.from_iterable(split))), dtype=np.uint64)
    shingles = shingle_hashes(h, shingle)
    lines, sets, columns, at = [], [], [[np.zeros(0, dtype=np.int64)] for _ in range(5)], 0
    for k, text in enumerate(split):
        ends = np.cumsum([len(line) for line in text])
        for place, (end, line) in enumerate(zip((ends + at).tolist(), text)):
            n = len(line)
            if n >= least:
                lines.append((first + k, place, n))
                sets.append(np.unique(shingles[end - n : end - shingle + 1] if n >= shingle else shingle_hashes(h[end - n : end], n)))
        pieces, starts = _piece_starts(h[at : at + ends[-1]])
        places = [np.searchsorted(ends, x, side="right") for x in (starts, starts + PIECE - 1)]
        for column, x in zip(columns, (np.full(len(starts), first + k), pieces, starts, *places)):
            column.append(x)
        at += int(ends[-1])
    keys = minhash_keys(sets, bands, rows)
    owners, places, words = (pa.array(c, pa.int64()) for c in (zip(*lines) if lines else ([], [], [])))
    named = pa.array([_named(s) for s in sets], pa.int64())
    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
    yield _rows(id=ids.take(owners), place=places, n_words=words, node=named, keys=keys)
    owners, pieces, starts, places, lasts = (pa.array(np.concatenate(c), pa.int64()) for c in columns)
    yield _rows(id=ids.take(owners), place=places, piece=pieces, start=starts, last_place=lasts)


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``SCANNED`` rows, null where no column is given."""
    n = len(columns["id"])
    types = {c: pa.list_(pa.int64()) if c == "keys" else pa.int64() for c in SCANNED}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()], list(SCANNED))


def _sets(shingle: int, least: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("places").to_pylist()
            for first, texts in text_groups(batch, "text"):
                found = []
                for k, text in enumerate(texts):
                    places = set(wanted[first + k])
                    found += [shingle_set(line, shingle) for place, line, _ in _paragraphs(text, least) if place in places]
                columns = [pa.array([_named(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return sets


def _repeated_pieces(pieces: DataFrame, removed: DataFrame) -> DataFrame:
    """The pieces that another document has too. Those in lines that go anyway, ``removed (id, place)``, do not count."""
    # Most pieces have one document only and need not meet the lines.
    several = pieces.groupBy("piece").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    several = written(several.filter("a < b").select("piece", "n"), "pieces-of-several")
    gone = removed.groupBy("id").agg(F.collect_set("place").alias("gone"))
    within = F.exists("gone", lambda x: (x >= F.col("place")) & (x <= F.col("last_place")))
    left = salted_join(pieces, several.select("piece"), "piece", several).join(gone, "id", "left")
    left = left.filter(~F.coalesce(within, F.lit(False)))
    pieces = written(left.select("id", "piece", "start", "place"), "pieces")
    keep = F.min(F.struct("id", "start", "place")).alias("keep")
    clusters = pieces.groupBy("piece").agg(keep, F.max("id").alias("last"), F.count("*").alias("n")).filter("keep.id < last")
    clusters = written(clusters, "piece-clusters")
    hit = salted_join(pieces, clusters.select("piece", "keep"), "piece", clusters)
    per_piece = hit.select("piece", "id").distinct().groupBy("piece").agg(F.count("*").alias("n_documents"))
    return salted_join(hit, per_piece, "piece", clusters.select("piece", "n"))


def repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD,
    recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """A row for every paragraph that another document has too, exactly or nearly, and every piece it has exactly.

    ``(id, paragraph, n_words, keep_id, keep_paragraph, n_documents, removed, start_word)``: ``paragraph`` is the number of the
    line in its text, ``start_word`` for a piece the number of its first word in the text (``paragraph`` is the line of that
    word), else null; pieces in removed paragraphs give no row. ``keep_id`` and ``keep_paragraph`` are the first of its component, the only one that is not
    ``removed``. Words are split at ASCII white space and A-Z lower-cased. Documents without such a paragraph give no row, nor
    do null and empty texts. Rows without an id are left out, as nothing could name them. Repeated rows repeat their
    paragraphs; they count as one document. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    bands, band_rows = bands_for(float(threshold), recall)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    schema = ", ".join(f"{c} {'array<bigint>' if c == 'keys' else 'bigint'}" for c in SCANNED)
    scanned = written(rows.mapInArrow(_scanned(shingle, least_words, bands, band_rows), schema), "paragraphs")
    paragraphs = scanned.filter("node is not null").select("id", "place", "n_words", "node", "keys")
    pieces = scanned.filter("piece is not null").select("id", "piece", "start", "place", "last_place")

    def sets_of(wanted: DataFrame) -> DataFrame:
        first = paragraphs.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "place")).alias("at"))
        places = first.groupBy(F.col("at.id").alias("id")).agg(F.collect_set("at.place").alias("places"))
        found = rows.join(places, "id").mapInArrow(_sets(shingle, least_words), "node bigint, shingles binary")
        found = found.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
        return written(found, "shingle-sets")

    spread = paragraphs.select("node", F.explode("keys").alias("key"))
    components = key_components([spread], sets_of, threshold)
    at = F.struct("id", "place")
    nodes = paragraphs.groupBy("node").agg(F.min(at).alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    nodes = written(
        nodes.join(components, "node", "left").select("node", "first", "last", "n", F.coalesce("component", "node").alias("c")),
        "passage-nodes",
    )
    clusters = nodes.groupBy("c").agg(F.min("first").alias("keep"), F.max("last").alias("last"), F.count("*").alias("n"))
    clusters = clusters.filter(F.col("keep.id") < F.col("last"))
    clusters = written(clusters, "passage-clusters")
    of_node = salted_join(nodes.select("c", "node"), clusters.select("c", "keep"), "c", clusters)
    hit = salted_join(paragraphs.select("id", "place", "n_words", "node"), of_node, "node", nodes)
    per_document = hit.select("c", "id").distinct().groupBy("c").agg(F.count("*").alias("n_documents"))
    removed = (F.col("id") != F.col("keep.id")) | (F.col("place") != F.col("keep.place"))
    counts = hit.groupBy("c").agg(F.count("*").alias("n"))
    lines = salted_join(hit, per_document, "c", counts).select(
        F.col("id").alias(id_column),
        F.col("place").alias("paragraph"),
        "n_words",
        F.col("keep.id").alias("keep_id"),
        F.col("keep.place").alias("keep_paragraph"),
        "n_documents",
        removed.alias("removed"),
        F.lit(None).cast("bigint").alias("start_word"),
    )
    lines = written(lines, "passage-lines")
    pieces = _repeated_pieces(pieces, lines.filter("removed").select(F.col(id_column).alias("id"), F.col("paragraph").alias("place")))
    return lines.unionByName(
        pieces.select(
            F.col("id").alias(id_column),
            F.col("place").alias("paragraph"),
            F.lit(PIECE).cast("bigint").alias("n_words"),
            F.col("keep.id").alias("keep_id"),
            F.col("keep.place").alias("keep_paragraph"),
            "n_documents",
            ((F.col("id") != F.col("keep.id")) | (F.col("start") != F.col("keep.start"))).alias("removed"),
            F.col("start").alias("start_word"),
        )
    )


def _cut(text: str | None, places: list | None, starts: list | None) -> str | None:
    if text is None or not (places or starts):
        return text
    data, gone = text.encode(), set()
    for start in starts or ():
        gone.update(range(start, start + PIECE))
    lines, words = [], 0
    for place, line in enumerate(data.split(b"\n")):
        spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", line)]
        cut = [k for k in range(len(spans)) if words + k in gone]
        words += len(spans)
        if place in (places or ()) or (cut and len(cut) == len(spans)):
            continue
        if cut:  # a word goes with the space behind it
            nexts = [x for x, _ in spans[1:]] + [len(line)]
            drop = set(cut)
            line = line[: spans[0][0]] + b"".join(line[spans[k][0] : nexts[k]] for k in range(len(spans)) if k not in drop)
        lines.append(line)
    return b"\n".join(lines).decode()


def without_passages(docs: DataFrame, passages: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the paragraphs and pieces that ``passages`` says to remove."""
    ship_package(docs.sparkSession)
    whole = F.when(F.col("start_word").isNull(), F.col("paragraph"))
    cut = passages.filter("removed").groupBy(F.col(id_column).alias("_cut_id"))
    cut = cut.agg(F.collect_set(whole).alias("_places"), F.collect_set("start_word").alias("_starts"))
    both = docs.join(cut, F.col(id_column) == F.col("_cut_id"), "left")
    text = F.udf(_cut, "string")(text_column, "_places", "_starts")
    kept = F.when(F.col("_cut_id").isNull(), F.col(text_column)).otherwise(text)
    return both.withColumn(text_column, kept).select(*docs.columns)
