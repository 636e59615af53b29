"""URL filters by dated lists.

The dated changes of a list become intervals in which an entry is valid, and every capture is judged by the entries
that were valid when it was fetched: an as-of join over the keys that a URL can match, in buckets of time.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.skew import salted_join
from parley.plans.storage import written

BUCKET_DAYS = 30


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path without query, fragment and final slashes; empty for the root."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def validity_intervals(changes: DataFrame) -> DataFrame:
    """``(kind, pattern, valid_from, valid_to)`` from changes ``(kind, pattern, action, at)``.

    An ``add`` is valid until the next change of the same entry, without end if there is none. At one moment
    ``remove`` is the last word. Changes without a kind, pattern or date are no changes.
    """
    usable = changes.filter("kind is not null and pattern is not null and at is not null")
    in_order = Window.partitionBy("kind", "pattern").orderBy("at", "action")
    following = usable.withColumn("valid_to", F.lead("at").over(in_order))
    found = following.filter("action = 'add' and (valid_to is null or valid_to > at)")
    return found.select("kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(time) / (86_400 * days)).cast("bigint")


def url_verdicts(
    captures: DataFrame, changes: DataFrame, id_column: str = "page_id", url_column: str = "url",
    time_column: str = "fetched_at", bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Per capture: ``(id, host, n_entries, blocked_by, kept)``.

    ``changes (kind, pattern, action, at)`` is a list: kind ``domain`` matches a host and all below it, ``prefix`` a host
    with the beginning of a path, ending where a part of the path ends. ``n_entries`` counts the entries that were valid
    at fetch time and match, ``blocked_by`` is the longest, by name where they tie, and ``kept`` says that there is none.
    A URL without a host matches nothing, nor does a capture without a time. Repeated captures are judged alike, each in
    a row of its own; an empty list keeps all. Other columns are not read.
    """
    rows = captures.select(
        F.col(id_column).alias("id"),
        url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
        F.col(time_column).alias("at"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    intervals = written(validity_intervals(changes), "list-intervals")
    parts = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    parts = parts.otherwise(F.size(F.split("pattern", "/")) - 1)
    depth = lambda kind: F.coalesce(  # noqa: E731  no key is longer than the list's longest
        intervals.filter(F.col("kind") == kind).agg(F.max(parts).alias("most")).scalar(), F.lit(-1)
    )
    labels = F.split("host", r"\.")
    steps = F.split("path", "/")
    domain_most, prefix_most = F.col("domain_most"), F.col("prefix_most")
    none = F.array().cast("array<string>")
    domains = F.transform(
        F.sequence(F.lit(1), domain_most), lambda k: F.concat(F.lit("domain "), F.array_join(F.slice(labels, -k, k), "."))
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), prefix_most),
        lambda k: F.concat(F.lit("prefix "), F.col("host"), F.array_join(F.slice(steps, 1, k + 1), "/")),
    )
    keys = F.concat(F.when(domain_most >= 1, domains).otherwise(none), F.when(prefix_most >= 0, prefixes).otherwise(none))
    dated = rows.filter("host is not null and at is not null").withColumns(
        {"domain_most": F.least(F.size(labels), depth("domain")), "prefix_most": F.least(F.size(steps) - 1, depth("prefix"))}
    )
    asked = dated.select("row", "at", _bucket(F.col("at"), bucket_days).alias("bucket"), F.explode(keys).alias("key"))

    # An interval has a row for every bucket of time it touches, up to the last capture.
    span = rows.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    span = written(span, "capture-span")
    first, last = (_bucket(span.select(c).scalar(), bucket_days) for c in ("first", "last"))
    begin = F.greatest(_bucket(F.col("valid_from"), bucket_days), first)
    end = F.least(F.coalesce(_bucket(F.col("valid_to"), bucket_days), last), last)
    entries = intervals.select(
        F.concat_ws(" ", "kind", "pattern").alias("key"), "pattern", "valid_from", "valid_to",
        begin.alias("begin"), end.alias("end"),
    ).filter("begin <= end")
    entries = entries.select("key", "pattern", "valid_from", "valid_to", F.explode(F.sequence("begin", "end")).alias("bucket"))
    met = salted_join(asked, entries, ["key", "bucket"])
    met = met.filter((F.col("at") >= F.col("valid_from")) & F.coalesce(F.col("at") < F.col("valid_to"), F.lit(True)))
    found = met.groupBy("row").agg(
        F.count("*").alias("n_entries"),
        F.min(F.struct(-F.length("pattern"), "key")).alias("longest"),
    )
    judged = rows.select("row", "id", "host").join(found, "row", "left")
    return judged.select(
        F.col("id").alias(id_column),
        "host",
        F.coalesce("n_entries", F.lit(0).cast("bigint")).alias("n_entries"),
        F.col("longest.key").alias("blocked_by"),
        F.col("n_entries").isNull().alias("kept"),
    )
