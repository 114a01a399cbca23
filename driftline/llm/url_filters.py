"""URL filters by a temporal list join, in Spark expressions only.

A list is a table of dated entries: list name, value, what was done (add or remove) and on which day. A value is a host or
domain, which stands for all hosts below it too, or a host and a path ("host/a/b"), which stands for all urls of that host
whose path begins with these segments. Entries become validity intervals: an entry holds from its day until the next entry
of the same list and value. An as-of join then evaluates every capture against what was active when it was fetched: a
capture's host, its parent domains and its path's beginnings meet the intervals by equality of value and time bucket
(BUCKET_DAYS; an interval goes to all buckets that it touches), and the interval must hold the fetch time. So a capture
meets what was listed about then, not a value's whole history.

The interval side is a table in the shared folder and broadcast only if its measured bytes are few; otherwise both sides
are shuffled by value and bucket, and adaptive execution splits hosts with many captures. A capture gives one row for each
label of its host, and one for each segment of its path as far as entries have any.

Odd rows: several entries of a list and value on one day count as the last by action (a remove outweighs an add); null
days or values are no entries; a null url, a url without a host or a null fetch time is never blocked; equal captures
get equal results each; empty tables give nothing blocked or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.shared import measured_broadcast, written

BUCKET_DAYS = 32


def host(url: Column) -> Column:
    """The host of a url in lower case, without user, port or final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    return F.rtrim(F.lower(authority), F.lit("."))


def segments(url: Column) -> Column:
    """The path of a url as an array of its segments that aren't empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def domains(name: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(name, r"\.")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def beginnings(name: Column, path: Column, depth: int) -> Column:
    """The host with the first one to `depth` segments of a path."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(max(1, depth))), lambda i: i <= F.least(F.size(path), F.lit(depth)))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(steps, lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(path, 1, i), "/"))))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at.cast("timestamp")) / (86_400 * BUCKET_DAYS)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, value, valid_from, valid_to (null: still active) from dated entries list_name, value, action, day.

    Hosts are in lower case; a path after one keeps its case and loses slashes at its end.
    """
    name = F.lower(F.substring_index("value", "/", 1))
    value = F.concat(name, F.rtrim(F.expr("substring(value, 1 + char_length(substring_index(value, '/', 1)))"), F.lit("/")))
    days = entries.where("value IS NOT NULL AND day IS NOT NULL").groupBy("list_name", value.alias("value"), "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "value").orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'").select("list_name", "value", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, url, fetch time, blocked, n_lists, lists (names, sorted, comma-joined) for every capture."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    active = written(intervals(entries), "intervals")
    depth = active.agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    span = rows.agg(F.min(_bucket(F.col("at"))).alias("low"), F.max(_bucket(F.col("at"))).alias("high")).first()
    low, high = (F.lit(span[0] or 0), F.lit(span[1] or 0))
    touched = F.sequence(F.greatest(_bucket(F.col("valid_from")), low), F.least(F.coalesce(_bucket(F.col("valid_to")), high), high))
    spread = active.where((_bucket(F.col("valid_from")) <= high) & (F.coalesce(_bucket(F.col("valid_to")), high) >= low)).withColumn("bucket", F.explode(touched))
    name, path = host(F.col("url")), segments(F.col("url"))
    values = F.concat(domains(name), beginnings(name, path, depth)) if depth else domains(name)
    keyed = rows.where("at IS NOT NULL").distinct().withColumn("value", F.explode(values)).withColumn("bucket", _bucket(F.col("at")))
    met = keyed.join(measured_broadcast(spread), ["value", "bucket"]).where("at >= valid_from AND (valid_to IS NULL OR at < valid_to)")
    found = met.groupBy("id", "url", "at").agg(F.array_sort(F.collect_set("list_name")).alias("lists"))
    r, f = rows.alias("r"), found.alias("f")
    same = F.col("r.id").eqNullSafe(F.col("f.id")) & F.col("r.url").eqNullSafe(F.col("f.url")) & F.col("r.at").eqNullSafe(F.col("f.at"))
    lists = F.coalesce("f.lists", F.array().cast("array<string>"))
    return r.join(f, same, "left").select(F.col("r.id").alias(id_col), F.col("r.url").alias(url_col), F.col("r.at").alias(time_col), (F.size(lists) > 0).alias("blocked"), F.size(lists).cast("long").alias("n_lists"), F.array_join(lists, ",").alias("lists"))
