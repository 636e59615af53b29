"""Compressed vectors: product codes from Lloyd rounds whose members stay where their entry lives.

A vector is cut into parts, and every part position has a codebook of a few entries. The parts are dealt to Spark
partitions by (position, entry, salt): the owner of an entry's share holds the parts assigned to it, adds them up in place,
and sends on one sum per entry. After the entries moved, each part looks for its nearest entry where it lies, and only parts
whose entry changed go through the next shuffle. What stays is united with what arrives without a shuffle, because
both have the same partitioner. The salt follows the row, so an entry that holds every part is spread over all owners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shingles import mix
from parley.operators.skew import salted_join
from parley.plans.shipping import ship_package
from parley.plans.storage import shared_dir, written

OWNER_PARTS = 1 << 20  # parts that an owner's partition holds on average, at most
CHECKPOINT_ROUNDS = 3  # rounds after which the lineage of the members is cut
LARGEST = 1 << 27  # of a component's integer: sums and squared distances then fit in 64 bits

Members = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # position, entry, row, values of each part


@dataclass(frozen=True)
class CodeOptions:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


@dataclass(frozen=True)
class VectorCodes:
    """``codes (vec_id, label, code, error)`` and the codebooks as integers by part, entry and place in the part."""

    codes: DataFrame
    codebooks: np.ndarray


def _partition(key: int) -> int:
    return key


def _place(position: np.ndarray, entry: np.ndarray, row: np.ndarray, entries: int, partitions: int) -> np.ndarray:
    """The partition of (position, entry, salt); the salt is a hash of the row."""
    salt = (mix(row.view(np.uint64)) % np.uint64(partitions)).astype(np.int64)
    return (position.astype(np.int64) * entries + entry + salt) % partitions


def _nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part, the lower one on ties, and its squared distance; exact."""
    largest = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Floating point is exact as long as no sum passes 2^53, and much faster.
    kind = np.float64 if 4 * largest * largest * values.shape[1] < 1 << 53 else np.int64
    x, c = values.astype(kind), book.astype(kind)
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    entry = squares.argmin(axis=1)
    return entry.astype(np.int16), squares[np.arange(len(x)), entry].astype(np.int64)


def _assigned(position: np.ndarray, values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry, error = np.zeros(len(position), dtype=np.int16), np.zeros(len(position), dtype=np.int64)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        entry[at], error[at] = _nearest(values[at], books[p])
    return entry, error


def _blocks(position, entry, row, values, options: CodeOptions, partitions: int) -> Iterator[tuple[int, Members]]:
    """The parts as one block for each partition that they go to."""
    place = _place(position, entry, row, options.entries, partitions)
    order = np.argsort(place, kind="stable")
    bounds = np.flatnonzero(np.diff(place[order])) + 1
    for at in np.split(order, bounds) if len(order) else ():
        yield int(place[at[0]]), (position[at], entry[at], row[at], values[at])


def _resident(blocks: Iterator[tuple[int, Members]], width: int) -> Members:
    """All parts of a partition, in one piece."""
    found = [members for _, members in blocks]
    if not found:
        empty = lambda kind: np.zeros(0, dtype=kind)
        return empty(np.int16), empty(np.int16), empty(np.int64), np.zeros((0, width), dtype=np.int32)
    return tuple(np.concatenate(x) for x in zip(*found))


def _dealt(options: CodeOptions, partitions: int, dims: int, books):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dims // options.parts
        for batch in batches:
            rows = batch.column("row").to_numpy()
            values = batch.column("vals").flatten().to_numpy().reshape(len(rows) * options.parts, width)
            if np.abs(values.astype(np.int64)).max(initial=0) > LARGEST:
                raise ValueError(f"a component times {options.scale} is beyond {LARGEST}: its codes would not be exact")
            position = np.tile(np.arange(options.parts, dtype=np.int16), len(rows))
            entry, _ = _assigned(position, values, books.value)
            blocks = list(_blocks(position, entry, np.repeat(rows, options.parts), values, options, partitions))
            columns = [pa.array([place for place, _ in blocks], pa.int64())]
            columns += [pa.array([members[k].tobytes() for _, members in blocks], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["place", "position", "entry", "row", "vals"])

    return dealt


def _members(line, width: int) -> tuple[int, Members]:
    kinds = (np.int16, np.int16, np.int64, np.int32)
    position, entry, row, values = (np.frombuffer(x, dtype=kind) for x, kind in zip(line[1:], kinds))
    return line[0], (position, entry, row, values.reshape(-1, width))


def _owner_sums(options: CodeOptions, width: int):
    def sums(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[int, np.ndarray]]:
        position, entry, _, values = _resident(blocks, width)
        for p in np.unique(position):
            at = position == p
            total = np.zeros((options.entries, width + 1), dtype=np.int64)
            np.add.at(total, entry[at], np.column_stack([values[at].astype(np.int64), np.ones(at.sum(), dtype=np.int64)]))
            yield int(p), total

    return sums


def _migrating(options: CodeOptions, partitions: int, width: int, books):
    """What stays in a partition as its own block, and blocks of the parts whose entry changed, each marked."""

    def migrating(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[int, tuple[bool, Members]]]:
        blocks = list(blocks)
        if not blocks:
            return
        here = blocks[0][0]
        position, before, row, values = _resident(iter(blocks), width)
        entry, _ = _assigned(position, values, books.value)
        moves = entry != before
        stays = ~moves
        yield here, (False, (position[stays], entry[stays], row[stays], values[stays]))
        for place, members in _blocks(position[moves], entry[moves], row[moves], values[moves], options, partitions):
            yield place, (True, members)

    return migrating


def _codes_of(options: CodeOptions, width: int, books):
    def codes(blocks: Iterator[tuple[int, Members]]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        position, _, row, values = _resident(blocks, width)
        entry, error = _assigned(position, values, books.value)
        if len(row):
            yield tuple(bytearray(x.tobytes()) for x in (row, position, entry, error))

    return codes


def _spread_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"row": np.int64, "position": np.int16, "entry": np.int16, "error": np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            columns = [np.frombuffer(batch.column(c)[k].as_py(), dtype=kind).astype(np.int64) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(kinds))


def _moved_books(books: np.ndarray, sums: dict[int, np.ndarray]) -> np.ndarray:
    """Every entry at the mean of its parts, rounded down; one without parts stays."""
    moved = books.copy()
    for p, total in sums.items():
        count = total[: books.shape[1], -1]
        used = count > 0
        moved[p][used] = total[: books.shape[1]][used, :-1] // count[used, None]
    return moved


def resident_rounds(
    members: RDD, books: np.ndarray, options: CodeOptions, partitions: int
) -> tuple[RDD, np.ndarray, list[RDD]]:
    """Lloyd rounds over ``members`` dealt by ``books``: the members where they end, the last codebooks, what is persisted.

    The codebooks are the only data that pass the driver: ``entries`` times the length of a vector.
    """
    spark_context, width = members.context, books.shape[2]
    held: list[RDD] = []
    for k in range(options.rounds):
        sums = members.mapPartitions(_owner_sums(options, width)).reduceByKey(np.add, options.parts)
        books = _moved_books(books, sums.collectAsMap())
        for rdd in held[:-1]:  # the last one is there by now, and holds all that the next step reads
            rdd.unpersist()
        del held[:-1]
        if k == options.rounds - 1:
            break
        step = _migrating(options, partitions, width, spark_context.broadcast(books))
        dealt = members.mapPartitions(step, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        stay = dealt.filter(lambda kv: not kv[1][0]).mapValues(lambda v: v[1])
        # Plain map: the keys of what moves are new, so the partitioner of its old place must not be kept.
        moved = dealt.filter(lambda kv: kv[1][0]).map(lambda kv: (kv[0], kv[1][1])).partitionBy(partitions, _partition)
        members = stay.union(moved.mapValues(lambda v: v))
        if (k + 1) % CHECKPOINT_ROUNDS == 0:
            members.checkpoint()
        held.append(dealt)
    return members, books, held


def _starting_books(kept: DataFrame, options: CodeOptions, dims: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids; rows that share an id give their smallest vector."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(order).limit(options.entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    chosen = F.coalesce(chosen, F.lit(False)) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = kept.filter(chosen).groupBy("vec_id").agg(F.min("vals").alias("vals")).orderBy(order).collect()
    vectors = np.array([r["vals"] for r in first], dtype=np.int64)
    return vectors.reshape(len(first), options.parts, dims // options.parts).transpose(1, 0, 2).copy()


def vector_codes(
    vectors: DataFrame, options: CodeOptions = CodeOptions(),
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> VectorCodes:
    """Codes of all usable vectors: two hex digits for each part, in order, and the squared error of the whole.

    Every component x becomes ``floor(scale * x)``. The codebooks start as the parts of the vectors with the ``entries``
    smallest ids (fewer if there are fewer ids; null ids come last; of rows that share an id the smallest vector
    counts). Each round assigns all parts to their nearest entry, the lower one on ties, and moves each entry to the mean
    of its parts, rounded down; an entry without parts stays. Then the parts are assigned once more.

    Rows whose vector is null, or holds null or non-finite components, are dropped; so are empty vectors and those of another length
    than most have. Repeated rows each get a row. No usable vector gives no rows and no codebooks. A length that
    ``parts`` does not divide, or a component whose integer is beyond 2^27, raises. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shared_dir(spark)
    if not 0 < options.entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    vector = F.col("_vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("_vector")
    ).filter(vector.isNotNull() & (F.size(vector) > 0) & finite)
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * options.scale).cast("int"))
    kept = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", values.alias("vals")), "vectors")
    length = F.size("vals")
    sizes = kept.groupBy(length.alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    label_type = vectors.schema[label_column].dataType.simpleString()
    id_type = vectors.schema[id_column].dataType.simpleString()
    if sizes is None:
        schema = f"vec_id {id_type}, label {label_type}, code string, error bigint"
        return VectorCodes(spark.createDataFrame([], schema), np.zeros((options.parts, 0, 0), dtype=np.int64))
    dims, n = sizes["dims"], sizes["n"]
    if dims % options.parts:
        raise ValueError(f"vectors of {dims} components have no {options.parts} equal parts")
    kept = kept.filter(length == dims)
    width = dims // options.parts
    books = _starting_books(kept, options, dims)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * options.parts // OWNER_PARTS))
    context = spark.sparkContext
    blocks = kept.select("row", "vals").mapInArrow(
        _dealt(options, partitions, dims, context.broadcast(books)),
        "place bigint, position binary, entry binary, row binary, vals binary",
    )
    members = blocks.rdd.map(lambda line: _members(line, width)).partitionBy(partitions, _partition)
    members, books, held = resident_rounds(members.mapValues(lambda v: v), books, options, partitions)
    codes = members.mapPartitions(_codes_of(options, width, context.broadcast(books)))
    codes = spark.createDataFrame(codes, "row binary, position binary, entry binary, error binary")
    parts = codes.mapInArrow(_spread_codes, "row bigint, position bigint, entry bigint, error bigint")
    digits = [F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex("entry"), 2, "0")))) for p in range(options.parts)]
    whole = parts.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    coded = written(kept.select("row", "vec_id", "label").join(whole, "row").drop("row"), "vector-codes")
    for rdd in held:
        rdd.unpersist()
    return VectorCodes(coded, books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over the rows of equal label, null labels together."""
    keyed = codes.withColumns({"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = written(keyed.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return salted_join(keyed, sums.drop("n"), ["_null", "_label"], sums).drop("_null", "_label")


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, joined by commas, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
