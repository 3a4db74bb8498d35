"""Crawl state as tables: the latest word on each address, counts, and the log's view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "seq bigint, action string, url string, local_path string, error string, timestamp double"


def latest_url_map(log: DataFrame) -> DataFrame:
    """url and local_path, the last by seq of each address that was saved."""
    return log.where("action = 'visited' AND local_path IS NOT NULL").groupBy("url").agg(F.max_by("local_path", "seq").alias("local_path"))


def latest_errors(log: DataFrame) -> DataFrame:
    """url and error, the last by seq. A later success does not take an address off."""
    return log.where("action = 'failed'").groupBy("url").agg(F.max_by("error", "seq").alias("error"))


def summarise(log: DataFrame, pending: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """One row: visited, pending, failed, blobs, elapsed (seconds, rounded half-even to two places), timestamp (the last)."""
    spark = log.sparkSession
    if pending is None:
        pending = spark.createDataFrame([], "url string")
    if blobs is None:
        blobs = spark.createDataFrame([], "sha256 string")
    of = lambda action: F.count_distinct(F.when(F.col("action") == action, F.col("url")))
    counts = log.agg(
        of("visited").alias("visited"), of("failed").alias("failed"), F.bround(F.max("timestamp") - F.min("timestamp"), 2).alias("elapsed"),
        F.max("timestamp").alias("timestamp"))
    more = pending.agg(F.count_distinct("url").alias("pending")).crossJoin(blobs.agg(F.count_distinct("sha256").alias("blobs")))  # one row each
    return counts.crossJoin(more).select("visited", "pending", "failed", "blobs", "elapsed", "timestamp")


def progress(log: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: done, total and percent."""
    from ..functions.text import progress_percent

    done = log.agg(F.count_distinct(F.when(F.col("action") == "visited", F.col("url"))).alias("done"))
    rest = pending.agg(F.count_distinct("url").alias("rest"))
    both = done.crossJoin(rest).select("done", (F.col("done") + F.col("rest")).alias("total"))  # one row each
    return both.select("done", "total", progress_percent(F.col("done"), F.col("total")).alias("percent"))


def log_tail(log: DataFrame, lines: int = 10_000) -> DataFrame:
    """The last lines of the log, the newest first."""
    return log.orderBy(F.desc("seq")).limit(lines)
