"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without one gets a fresh folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parley-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stage_paths: list[str] | None = None  # tables written by the stages of a job so far, where they are to be dropped


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The table, cut from its lineage: computed once, and it outlives the executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    if _stage_paths is not None:
        _stage_paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def written_in_buckets(parts: Iterable[DataFrame], column: str, name: str) -> DataFrame:
    """The tables one after the other as one table in buckets by ``column``: a join by it need not move this table again."""
    table = None
    for part in parts:
        spark = part.sparkSession
        if table is None:
            path, buckets = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
            table = _table_name(path)
            if _stage_paths is not None:
                _stage_paths.append(path)
        part.write.bucketBy(buckets, column).saveAsTable(table, format="parquet", mode="append", path=path)
    return spark.table(table)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` or ``written_in_buckets`` that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            _deleted(spark, folder)
            if spark.catalog.tableExists(_table_name(folder)):
                spark.sql(f"DROP TABLE {_table_name(folder)}")


@contextmanager
def stage_scratch(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """One stage of a job whose stages are written and read again: its scratch tables go when the next stage begins.

    Tables that ``docs``, the input of this stage, still reads stay.
    """
    global _stage_paths
    earlier, read = getattr(spark, "_parley_stage_paths", []), docs.inputFiles()
    name = lambda path: path.rstrip("/").rsplit("/", 1)[1]  # noqa: E731 - the name is unique, schemes and hosts may differ
    kept = [p for p in earlier if any(f"/{name(p)}/" in file for file in read)]
    for path in earlier:
        if path not in kept:
            _deleted(spark, path)
    before, _stage_paths = _stage_paths, kept
    try:
        yield
    finally:
        spark._parley_stage_paths, _stage_paths = _stage_paths, before


@contextmanager
def set_to(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """Within it, the session's setting ``name`` is ``value``."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends: for loops that write each table they read again."""
    with set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield
