"""Comment tables from CSV: reading, column normalising and the load job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.config import REQUIRED_COLUMNS, CleanOptions
from parley.operators.filters import in_subreddits, preprocess, with_min_score
from parley.operators.sampling import first_n, sample_n
from parley.sources.ids import with_stable_ids

COMMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("controversiality", T.IntegerType()),
        T.StructField("score", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Other names a column may come under. The first match in this order wins.
COLUMN_ALIASES = {
    "text": ("body", "comment", "content", "comment_body", "selftext"),
    "score": ("ups", "upvotes", "points"),
    "timestamp": ("created", "created_utc", "date"),
    "author": ("user", "username"),
    "subreddit": ("sub", "sr"),
}
# Parts of a column name that suggest comment text.
TEXT_HINTS = ("text", "body", "comment")
# Strings a CSV file uses for a missing value (the ones pandas reads as NaN).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header as strings; quoted newlines, commas and doubled quotes stay in the text.

    No type is inferred, which would cost a second pass over the files. Quoted newlines mean that
    a file cannot be split, so a large table should come as many files.
    """
    # A file whose header differs from that of the first is an error; it would otherwise be misread.
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return rows.select([F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in rows.columns])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, known aliases renamed, defaults for what is missing.

    If several columns stand for the same thing, a column that already has the right name wins,
    then the first alias; the others are dropped.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    renames, dropped = {}, []
    for target, aliases in COLUMN_ALIASES.items():
        present = [c for c in (target, *aliases) if c in df.columns]
        if present:
            renames[present[0]] = target
            dropped += present[1:]
    original_first = df.columns[0]
    df = df.drop(*dropped).withColumnsRenamed(renames)
    if "text" not in df.columns:
        hinted = [c for c in df.columns if any(hint in c for hint in TEXT_HINTS)]
        first = renames.get(original_first, original_first)
        df = df.withColumn("text", F.col(hinted[0] if hinted else first).cast("string"))
    defaults = {
        "subreddit": F.lit("unknown"),
        "score": F.lit(0).cast("bigint"),
        "id": F.monotonically_increasing_id(),
        "timestamp": F.current_timestamp(),
    }
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})


def _whole_number(column: str) -> Column:
    """Whole number from text; '3.0', as written for a column with gaps, counts as 3."""
    value = F.col(column)
    return F.coalesce(value.try_cast("bigint"), value.cast("double").cast("bigint"))


def _moment(column: str) -> Column:
    """Timestamp from text, either written out or in seconds since 1970."""
    value = F.col(column)
    return F.coalesce(F.timestamp_seconds(value.try_cast("double")), value.try_cast("timestamp"))


def typed(df: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Give the known columns their types; columns that are not part of the schema stay as they are."""
    strings = {c for c, kind in df.dtypes if kind == "string"}
    convert = {}
    for field in COMMENT_SCHEMA:
        name, kind = field.name, field.dataType.simpleString()
        kind = id_type if name == "id" else kind
        if name not in df.columns:
            continue
        if name in strings and kind in ("bigint", "int"):
            convert[name] = _whole_number(name).cast(kind)
        elif name in strings and kind == "timestamp":
            convert[name] = _moment(name)
        else:
            convert[name] = F.col(name).cast(kind)
    return df.withColumns(convert)


def with_body(df: DataFrame) -> DataFrame:
    """The report reads ``body``; a normalised table has ``text``."""
    return df.withColumn("body", F.col("text")) if "body" not in df.columns and "text" in df.columns else df


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_comments(
    df: DataFrame,
    num_comments: int | None = None,
    subreddits: Iterable[str] | None = None,
    min_score: int | None = None,
    random_sample: bool = True,
    seed: int = 42,
    options: CleanOptions = CleanOptions(),
) -> DataFrame:
    """The load job after reading: take, normalise, filter, preprocess.

    Rows of a table without ids are numbered by their content where a number of comments is asked for.
    """
    if num_comments and "id" not in [c.lower() for c in df.columns]:
        df = with_stable_ids(df)  # a sample by ids that change would change as well
    df = typed(normalize_columns(df))
    if num_comments:
        df = sample_n(df, num_comments, seed) if random_sample else first_n(df, num_comments)
    if subreddits:
        df = in_subreddits(df, subreddits)
    if min_score is not None:
        df = with_min_score(df, min_score)
    return preprocess(df, options)


def load_comments(
    spark: SparkSession, path: str | list[str], *, profile: str = "clean", **selection
) -> DataFrame:
    """Comments from CSV. ``profile="raw"`` only reads and types them, for the report's raw mode."""
    rows = read_csv(spark, path)
    if profile == "raw":
        return typed(rows)
    return select_comments(rows, **selection)
