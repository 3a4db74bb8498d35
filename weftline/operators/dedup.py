"""Content-addressed storage: one file for each distinct body, and reports on paths that several addresses share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def content_hash(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256))


def canonical_blobs(rows: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """sha256, canonical (the first key by order) and copies for each distinct body. Only digests are shuffled."""
    hashed = rows.select(F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.col(key).alias("key"), F.col(order).alias("at"))
    return hashed.groupBy("sha256").agg(F.min_by("key", "at").alias("canonical"), F.count("*").alias("copies"))


def alias_bodies(rows: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """key, sha256, canonical and is_alias for every row.

    The blobs are written to the shared folder first. So rows and blobs meet by digest straight from two scans, and the
    adaptive skew join can split a digest that very many rows share.
    """
    hashed = rows.select(F.col(key).alias("key"), F.sha2(F.col(body).cast("binary"), 256).alias("sha256"))
    blobs = materialise(canonical_blobs(rows, key, order, body).select("sha256", "canonical"))
    return hashed.join(blobs, "sha256").select("key", "sha256", "canonical", (F.col("key") != F.col("canonical")).alias("is_alias"))


def path_collisions(saved: DataFrame) -> DataFrame:
    """local_path, urls (number) and winner (the last by seq) of paths that several addresses (url, local_path, seq) write."""
    return saved.groupBy("local_path").agg(F.count_distinct("url").alias("urls"), F.max_by("url", "seq").alias("winner")).where("urls > 1")
