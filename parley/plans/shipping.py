"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import parley


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_has_parley", False):
        return
    home = os.path.dirname(os.path.abspath(parley.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="parley-"), "parley")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(home), os.path.basename(home)))
    context._has_parley = True
