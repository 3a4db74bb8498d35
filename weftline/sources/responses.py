"""Fetching as a join: what a crawl asks for is looked up among recorded responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_body, declare_utf8


def fetch_pages(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """url, ok, status, final_url, content_type, text and error for each wanted url.

    A missing response or a status from 400 on is a failure with a null text. A response's rendered_html, where the
    table has the column and the row a value, takes the place of the decoded body.
    """
    met = wanted.join(responses, "url", "left")
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    text = decode_body(F.col("body"), F.col("content_type"))
    if "rendered_html" in responses.columns:
        text = F.coalesce("rendered_html", text)
    return met.select(
        "url", ok.alias("ok"), "status", F.coalesce("final_url", "url").alias("final_url"), "content_type", F.when(ok, text).alias("text"),
        F.when(~ok, F.lit("Fetch returned None")).alias("error"))


def fetch_assets(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """url, ok, sha256, bytes, body and error for each wanted asset."""
    met = wanted.join(responses.select("url", "status", "body"), "url", "left")
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    return met.select(
        "url", ok.alias("ok"), F.when(ok, F.sha2("body", 256)).alias("sha256"), F.when(ok, F.octet_length("body")).cast("long").alias("bytes"), F.when(ok, F.col("body")).alias("body"),
        F.when(~ok, F.lit("Asset download failed")).alias("error"))


def read_bodies(spark, path: str, pattern: str = "*") -> DataFrame:
    """local_path, body, bytes and sha256 of stored files; the reader passes over empty ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("local_path"), F.col("content").alias("body"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def saved_pages(fetched: DataFrame) -> DataFrame:
    """url and the text that is saved: what was fetched, declared as UTF-8."""
    return fetched.where("ok").select("url", declare_utf8(F.col("text")).alias("text"))
