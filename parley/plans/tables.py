"""The comment table as a view over the parquet test tables.

``documents`` gives id, text and community; ``labels`` the flag; ``events`` score, author and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_COLUMNS = {"controversiality"}
EVENT_COLUMNS = {"score", "author", "timestamp"}
ALL_COLUMNS = ("id", "body", "subreddit", "controversiality", "score", "author", "timestamp")


# Known schemas spare a job that would read them from the files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; the pattern lets it be one file or a folder of files."""
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when the input has fewer splits than there are cores.

    Only a small input has so few splits; a large one is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def comments(spark: SparkSession, sf_dir: str, *columns: str, **derived: Column) -> DataFrame:
    """The wanted columns of the comment view (all of them by default), reading no other table.

    ``derived`` are expressions on ``id``, ``body`` and ``subreddit``. They are computed before
    the joins, so a join moves a length or a token count instead of the text.
    """
    wanted = columns or ALL_COLUMNS
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    view = documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("subreddit")
    )
    own = [c for c in wanted if c not in LABEL_COLUMNS | EVENT_COLUMNS]
    view = view.select("id", *[c for c in own if c != "id"], *[e.alias(name) for name, e in derived.items()])
    if LABEL_COLUMNS & set(wanted):
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
        view = view.join(labels, "id", "left").withColumn("controversiality", F.coalesce("toxic", F.lit(0)))
    if EVENT_COLUMNS & set(wanted):
        events = table(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"),
            F.floor("value").cast("bigint").alias("score"),
            F.col("user_id").cast("string").alias("author"),
            F.col("ts").cast("timestamp").alias("timestamp"),
        )
        view = view.join(events, "id", "left")
    return view.select(*wanted, *derived)
