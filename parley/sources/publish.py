"""Several tables published as one version: readers see all of the new ones or all of the old ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from parley.sources.sinks import write_table

CURRENT = "CURRENT.json"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _written_text(spark: SparkSession, path: str, text: str) -> None:
    files, target = _filesystem(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _replaced(spark: SparkSession, source: str, target: str) -> None:
    """Rename ``source`` to ``target``, which may exist: in one step, as the file system's own rename does it."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.java.net.URI.create(_filesystem(spark, target)[0].getUri().toString()), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(_filesystem(spark, source)[1], _filesystem(spark, target)[1], options)


def publish(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> str:
    """Write the tables under a fresh version below ``path``, then make it the current one; returns the version's folder.

    The manifest ``CURRENT.json`` names the current version, its format and its tables. It is written beside itself and renamed as
    the last step, so a run that ends between two tables leaves the version before whole, and its own is never
    seen. Versions that are no longer current stay until ``drop_old_versions`` removes them.
    """
    if not tables:
        raise ValueError("there is no table to publish")
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{path}/{version}/{name}", fmt)
    manifest = {"version": version, "format": fmt, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}}
    draft = f"{path}/.{CURRENT}-{uuid.uuid4().hex}"
    _written_text(spark, draft, json.dumps(manifest, indent=1))
    _replaced(spark, draft, f"{path}/{CURRENT}")
    return f"{path}/{version}"


def current_version(spark: SparkSession, path: str) -> dict:
    """The manifest of the version that readers see."""
    files, target = _filesystem(spark, f"{path.rstrip('/')}/{CURRENT}")
    if not files.exists(target):
        raise FileNotFoundError(f"nothing is published below {path}")
    return json.loads("\n".join(row[0] for row in spark.read.text(str(target)).collect()))


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    manifest = current_version(spark, path)
    folder = f"{path.rstrip('/')}/{manifest['version']}"
    found = {}
    for name, schema in manifest["tables"].items():
        reader = spark.read.schema(StructType.fromJson(schema))
        if manifest["format"] == "csv":
            reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
        found[name] = reader.format(manifest["format"]).load(f"{folder}/{name}")
    return found


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove all versions but the current one; how many went. Not to be run while another job publishes or reads."""
    current = current_version(spark, path)["version"]
    files, folder = _filesystem(spark, path.rstrip("/"))
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version-")]
    old = [p for p in old if p.getName() != current]
    for p in old:
        files.delete(p, True)
    return len(old)
