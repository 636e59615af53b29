"""Packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of them is packed, longest
first, into the open window with the least room that still holds it. A segment tree over the remaining room
finds that window. Packers take bounded shares of the pieces, so their number follows the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.wordtokens import text_groups, word_tokens
from parley.plans.shipping import ship_package
from parley.plans.storage import written

WINDOW = 2048
PACKER_PIECES = 16_384
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


class RoomTree:
    """Open windows by remaining room; every inner node counts the windows below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``room``, taken out; None if there is none."""
        node = self.leaves + room
        if not self.counts[node]:
            # Up until a right neighbour holds a window, then down its left side.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        found = node - self.leaves
        while node:
            self.counts[node] -= 1
            node >>= 1
        return found, self.windows[found].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For lengths in falling order, each at most ``window``: the window and the offset of each."""
    tree, windows, offsets, opened = RoomTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        room, number = found
        windows.append(number)
        offsets.append(window - room)
        if room > length:
            tree.put(room - length, number)
    return windows, offsets


def _cut(path: str, end_id: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            ids_of_docs = batch.column("doc_id").cast(pa.int64())
            for first, texts in text_groups(batch, "text"):
                ids, bounds = tokens.encode(texts, end_id)
                ids = ids.astype("<u4")
                rows = []
                for k in range(len(texts)):
                    doc, doc_id = ids[bounds[k] : bounds[k + 1]], ids_of_docs[first + k].as_py()
                    for start in range(0, len(doc), window):
                        piece = doc[start : start + window]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(doc)))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's ids cut into full windows and a rest, described by ``PIECES``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, window), PIECES)


def _pack(window: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        numbers, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
        packer = table.column("packer")[0].as_py()
        table = table.drop_columns(["packer"])
        table = table.append_column("sequence_id", pa.array(np.array(numbers, dtype=np.int64) + (packer << 32)))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW,
                   id_column: str = "doc_id", text_column: str = "text", packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most ``window`` ids (``PACKED``).

    ``tokenizer`` is the path of a tokenizers file; every text's ids end with ``end_id``. A null or empty
    text is the end id alone. Repeated rows are packed as often as they come, null ids like any other. A text of any
    length is cut into windows. Ties of length go by id and start. Other columns are not read. No rows give no sequences.
    """
    cut = written(pieces(docs, tokenizer, end_id, window, id_column, text_column), "pieces")
    packers = max(1, -(-cut.count() // packer_pieces))
    # The number of a row of the written table spreads repeated rows as well.
    packer = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(packers)).alias("packer")
    return cut.select("*", packer).groupBy("packer").applyInArrow(_pack(window), PACKED)
