"""Stupid-backoff language model scores of documents, counted over the same corpus.

Texts become chunks of word numbers. Every chunk sends its different n-grams, with their counts, to the part of
the count tables that their hash belongs to. There the counts of all chunks are added up and joined back to the n-grams
that each chunk sent, in the order it sent them. The chunk's documents then look up their n-grams
and add up their scores. A frequent n-gram travels once per chunk, so it cannot burden a part.

What a chunk sends to a part is one row: a block of sorted hashes, stored as differences, with their counts. The more
parts a corpus needs, the smaller are the blocks, down to one n-gram a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shingles import mix, word_hashes
from parley.llm.wordtokens import text_groups
from parley.plans.shipping import ship_package
from parley.plans.storage import shuffles_dropped, written

ORDER = 3
BACKOFF = 0.4
LEAST_COUNT = 2
CHUNK_BYTES = 8 << 20
PART_GRAMS = 2_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lower case for A-Z and spaces for punctuation.
PLAIN = bytes(32 if c in PUNCTUATION else c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = "chunk string, ids array<bigint>, ends array<bigint>, vocabulary binary, words binary, n_words bigint"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _packed(numbers: np.ndarray) -> bytes:
    """Equal bytes of all numbers side by side, compressed: small numbers take little room."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _packed_ascending(hashes: np.ndarray) -> bytes:
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _chunk(ids: list, hashes: list[np.ndarray]) -> tuple:
    flat = np.concatenate(hashes)
    vocabulary, numbers, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which compress well
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    return (uuid.uuid4().hex, ids, ends, vocabulary[order].tobytes(), _packed(place[numbers]), len(flat))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        columns = [pa.array([x], t) for x, t in zip(_chunk(ids, hashes), types)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "ends", "vocabulary", "words", "n_words"])

    ids, hashes, size = [], [], 0
    for batch in batches:
        names = batch.column("id").to_pylist()
        for first, texts in text_groups(batch, "text", CHUNK_BYTES // 4):
            ids += names[first : first + len(texts)]
            hashes += [word_hashes(text, PLAIN) for text in texts]
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield row(ids, hashes)
                ids, hashes, size = [], [], 0
    if ids:
        yield row(ids, hashes)


def _grams(chunk: dict, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n from 1: the hashes of the n-grams, and the places of their last words."""
    vocabulary = np.frombuffer(chunk["vocabulary"], dtype=np.uint64)
    n = chunk["n_words"]
    words = vocabulary[_unpacked(chunk["words"], np.uint32)] if n else np.zeros(0, np.uint64)
    starts = np.repeat(np.array([0] + chunk["ends"][:-1], dtype=np.int64), np.diff([0] + chunk["ends"]))
    hashes, lasts = [mix(words + np.uint64(1))], [np.arange(n, dtype=np.int32)]
    at = np.zeros(n, dtype=np.uint64)
    for k in range(2, order + 1):
        last = lasts[-1][lasts[-1] - starts[lasts[-1]] >= k - 1]
        at[lasts[-1]] = hashes[-1]
        hashes.append(mix(at[last - 1] * _MULTIPLIER + words[last] + np.uint64(k)))
        lasts.append(last)
    return hashes, lasts


def _sent(order: int, bits: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                grams, counts = np.unique(np.concatenate(_grams(chunk, order)[0]), return_counts=True)
                parts = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), dtype=np.int64)
                present, starts = np.unique(parts, return_index=True)  # parts with nothing from this chunk get no row
                ends, counts = [*starts[1:], len(grams)], counts.astype(np.uint32)
                rows = [
                    (part, chunk["chunk"], _packed_ascending(grams[a:b]), _packed(counts[a:b]))
                    for part, a, b in zip(present.tolist(), starts, ends)
                ]
                if rows:
                    types = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "grams", "counts"])

    return sent


def _added(rows: pa.Table) -> pa.Table:
    """One part of the count tables: totals for every n-gram that a chunk sent, in its order."""
    sent = [_unpacked_ascending(g) for g in rows.column("grams").to_pylist()]
    counts = np.concatenate([_unpacked(c, np.uint32) for c in rows.column("counts").to_pylist()])
    grams, numbers = np.unique(np.concatenate(sent), return_inverse=True)
    totals = np.zeros(len(grams), dtype=np.int64)
    np.add.at(totals, numbers, counts.astype(np.int64))
    answers = np.split(totals[numbers], np.cumsum([len(s) for s in sent])[:-1])
    return pa.table(
        [rows.column("part"), rows.column("chunk"), pa.array([_packed(a) for a in answers], pa.binary())],
        ["part", "chunk", "totals"],
    )


def _scored(order: int, n_words: int, backoff: float, least: int):
    def scored(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        chunk = next(r for r in rows if r["part"] is None)
        answers = sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"])
        totals = np.concatenate([_unpacked(r["totals"], np.int64) for r in answers] or [np.zeros(0, dtype=np.int64)])
        hashes, lasts = _grams(chunk, order)
        # The totals come in the order of the different hashes; every position takes its own.
        numbers = np.unique(np.concatenate(hashes), return_inverse=True)[1]
        counts = np.split(totals[numbers], np.cumsum([len(h) for h in hashes])[:-1])
        score = np.log(counts[0] / max(n_words, 1))
        at = np.zeros(chunk["n_words"], dtype=np.int64)
        for k in range(1, order):
            # Seen often enough: count / count of what comes before; else the shorter n-gram, discounted.
            at[lasts[k - 1]] = counts[k - 1]
            seen = np.log(counts[k] / at[lasts[k] - 1])
            score[lasts[k]] = np.where(counts[k] >= least, seen, np.log(backoff) + score[lasts[k]])
        sums = np.concatenate([[0.0], np.cumsum(score)])
        ends = np.array([0] + chunk["ends"])
        sizes = np.diff(ends)
        per_doc = np.array([score[a:b].sum() for a, b in zip(ends[:-1], ends[1:])]) if len(sums) > 1 else np.zeros(len(sizes))
        columns = [pa.array(chunk["ids"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(per_doc, pa.float64())]
        return pa.table(columns, ["id", "n_words", "log_score"])

    return scored


def lm_scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, log_score, mean_log_score)`` under the n-gram counts of all of them.

    Words are lower-cased (A-Z) runs without ASCII punctuation and white space. A word's score is its n-gram's count over
    the count of the words before it, if the n-gram occurs ``least_count`` times; else ``backoff`` times the
    score by one word less of context; single words score their share of all words. ``log_score`` adds up the
    natural logarithms. A text without words, null included, scores 0 with a null mean. Repeated rows count as
    often as they come, null ids like any other. An empty table gives no rows. A long text is a chunk of its own, held
    whole by one task. Other columns are not read. N-grams are known by 64 bits of a hash: among n different ones
    two share a name with a probability below n^2 / 2^65, and would then share their counts.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    chunks = written(rows.mapInArrow(_chunks, CHUNK), "lm-chunks")
    n_words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = max(0, (-(-n_words * order // PART_GRAMS) - 1).bit_length())
    sent = chunks.mapInArrow(_sent(order, bits), "part int, chunk string, grams binary, counts binary")
    with shuffles_dropped(docs.sparkSession):
        # Written, the totals outlive the n-grams that were sent, which take most of the room.
        added = written(sent.groupBy("part").applyInArrow(_added, "part int, chunk string, totals binary"), "lm-totals")
    waiting = chunks.select(
        F.lit(None).cast("int").alias("part"), "chunk", F.lit(None).cast("binary").alias("totals"),
        "ids", "ends", "vocabulary", "words", "n_words",
    )
    met = waiting.unionByName(added, allowMissingColumns=True)
    scored = met.groupBy("chunk").applyInArrow(
        _scored(order, n_words, backoff, least_count), "id bigint, n_words bigint, log_score double"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_column), "n_words", "log_score", mean.alias("mean_log_score"))
