"""Token ids in binary files of fixed-width bit packing.

A shard holds the ids of documents in ascending id order. Layout, integers little-endian:

    magic "PIDS", u16 version, u16 bits, u32 ids per block
    blocks: ids of ``bits`` bits each, most significant bit first, every block padded to a byte
    i64 offset of every block and of the end of the last one
    i64 document ids, u8 whether an id is null, i64 where each document's ids end
    u64 blocks, u64 documents, u64 ids, u64 place of the block offsets, magic "PIDS"

``bits`` is the least that holds every id of the vocabulary. A block can be read alone by its offset,
and NumPy unpacks all its ids at once. Executors write shards to the shared folder under names
of their own; the table of shards names those of tasks that succeeded.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.wordtokens import text_groups, word_tokens
from parley.plans.shipping import ship_package
from parley.plans.storage import scratch_path, written

MAGIC, VERSION, BLOCK = b"PIDS", 1, 4096
HEAD, FOOT = struct.Struct("<4sHHI"), struct.Struct("<QQQQ4s")
SHARDS = "shard int, path string, n_docs bigint, n_ids bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
READ_BLOCKS = 256


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, most significant first; whole-byte widths need no single bits."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :]).tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8)).tobytes()


def unpack_ids(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits % 8 == 0:
        wide = np.zeros((count, 4), dtype=np.uint8)
        wide[:, 4 - bits // 8 :] = np.frombuffer(data, dtype=np.uint8, count=count * bits // 8).reshape(count, -1)
        return wide.view(">u4").ravel().astype("<u4")
    single = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits).reshape(count, bits)
    weights = np.left_shift(np.uint32(1), np.arange(bits - 1, -1, -1, dtype=np.uint32))
    return (single * weights).sum(axis=1, dtype=np.uint64).astype("<u4")


class ShardWriter:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.waiting = np.zeros(0, dtype=np.uint32)
        self.n_ids = 0
        self.offsets, self.ids, self.nulls, self.ends = [HEAD.size], [], [], []
        out.write(HEAD.pack(MAGIC, VERSION, bits, block))

    def _write(self, ids: np.ndarray) -> None:
        data = pack_ids(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        self.ids += [0 if x is None else x for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.ends += (bounds[1:] + self.n_ids).tolist()
        self.n_ids += len(ids)
        ids = np.concatenate([self.waiting, ids])
        full = len(ids) // self.block * self.block
        for k in range(0, full, self.block):
            self._write(ids[k : k + self.block])
        self.waiting = ids[full:]

    def close(self) -> None:
        if len(self.waiting):
            self._write(self.waiting)
        at = self.offsets[-1]
        self.out.write(np.array(self.offsets, dtype="<i8").tobytes())
        self.out.write(np.array(self.ids, dtype="<i8").tobytes())
        self.out.write(np.array(self.nulls, dtype="<u1").tobytes())
        self.out.write(np.array(self.ends, dtype="<i8").tobytes())
        self.out.write(FOOT.pack(len(self.offsets) - 1, len(self.ids), self.n_ids, at, MAGIC))


class ShardReader:
    """Documents of a shard, in order or by place; reads only the blocks that are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        blocks, docs, self.n_ids, at, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        head, _, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        if (head, magic) != (MAGIC, MAGIC):
            raise ValueError("not a whole shard")
        index = self._read(at, size - FOOT.size - at)
        self.offsets = np.frombuffer(index, "<i8", blocks + 1)
        ids = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        nulls = np.frombuffer(index, "<u1", docs, 8 * (blocks + 1 + docs))
        self.doc_ids = [None if n else i for i, n in zip(ids.tolist(), nulls.tolist())]
        self.ends = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1 + docs) + docs)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places ``first`` to ``last`` of the shard."""
        if first >= last:
            return np.zeros(0, dtype="<u4")
        low, high = first // self.block, (last - 1) // self.block + 1
        data = self._read(int(self.offsets[low]), int(self.offsets[high] - self.offsets[low]))
        parts, begin = [], int(self.offsets[low])
        if self.block * self.bits % 8 == 0:  # all but the last block end with a byte's last bit
            parts.append(unpack_ids(data, self.bits, min(high * self.block, self.n_ids) - low * self.block))
        else:
            for k in range(low, high):
                piece = data[int(self.offsets[k]) - begin : int(self.offsets[k + 1]) - begin]
                parts.append(unpack_ids(piece, self.bits, min((k + 1) * self.block, self.n_ids) - k * self.block))
        return np.concatenate(parts)[first - low * self.block : last - low * self.block]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.ends[place - 1]) if place else 0, int(self.ends[place]))


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


def _write_shards(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard = word_tokens(tokenizer), TaskContext.get().partitionId()
        system, name = _opened(folder)
        name = f"{name}/{shard:06d}-{uuid.uuid4().hex}.ids"
        writer = out = None
        for batch in batches:
            if writer is None:
                out = system.open_output_stream(name)
                writer = ShardWriter(out, bits_for(tokens.size))
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in text_groups(batch, "text"):
                ids, bounds = tokens.encode(texts, end_id)
                writer.add(doc_ids[first : first + len(texts)], ids, bounds)
        if writer is not None:
            writer.close()
            out.close()
            row = [[shard], [f"{folder}/{name.rsplit('/', 1)[1]}"], [len(writer.ids)], [writer.n_ids]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["shard", "path", "n_docs", "n_ids"])

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the documents' ids to shards in ``folder`` and return the table of shards (``SHARDS``), in order.

    Documents come in ascending id order, null ids first; rows with the same id by a hash of their text. Null and empty
    texts are the end id alone. Repeated rows are written as often as they come. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "token-files")
    system, name = _opened(folder)
    system.create_dir(name)
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.xxhash64(F.col(text_column)).alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # lets rows with one id be dealt to several shards
    )
    dealt = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(dealt.mapInArrow(_write_shards(folder, tokenizer, end_id), SHARDS), "token-shards")


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            system, name = _opened(shard["path"])
            with system.open_input_file(name) as file:
                reader = ShardReader(file)
                rows, low, held = [], 0, np.zeros(0, dtype="<u4")
                step = READ_BLOCKS * reader.block
                begin = 0
                for doc_id, end in zip(reader.doc_ids, reader.ends.tolist()):
                    crc, at = 0, begin
                    while at < end:
                        if at >= low + len(held):
                            low, held = at, reader.ids(at, min(at + step, reader.n_ids))
                        part = held[at - low : end - low]
                        crc, at = zlib.crc32(part.tobytes(), crc), at + len(part)
                    rows.append((doc_id, shard["first"] + begin, end - begin, crc))
                    begin = end
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of the shards: ``DOCUMENTS``, all of it read from the files.

    ``start`` is the number of ids before the document in all shards. One row per shard meets in one task for that.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))
    parts = max(1, shards.count())
    return placed.repartition(parts, "shard").mapInArrow(_read_documents, DOCUMENTS)
