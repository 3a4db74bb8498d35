"""Which links and assets a crawl takes up, with the first reason against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import wanted_kind


def decide_links(links: DataFrame, start: Column, visited: DataFrame, subdomains: bool = False, excluded_paths=(), strip: bool = True, url: str = "url") -> DataFrame:
    """Adds target (canonical, stripped) and decision: admitted, or the first reason against.

    Reasons in order: blank, scheme, policy, visited, path. visited has one row for each url. Both sides of the join are
    plain tables, so the adaptive skew join can split an address that very many pages link to.
    """
    plain = U.normalise(F.col(url))
    rows = links.withColumn("plain", plain).withColumn("target", U.strip_tracking(F.col("plain")) if strip else F.col("plain"))
    seen = visited.select(F.col("url").alias("target"), F.lit(True).alias("seen"))
    rows = rows.join(seen, "target", "left")
    reason = (
        F.when(F.coalesce(F.col("plain"), F.lit("")) == "", "blank")
        .when(U.is_excluded_scheme(F.col("plain")), "scheme")
        .when(~U.should_crawl(F.col("plain"), start, subdomains), "policy")
        .when(F.col("seen").isNotNull(), "visited")
        .when(U.is_excluded_path(F.col("plain"), excluded_paths), "path")
        .otherwise("admitted"))
    return rows.withColumn("decision", reason).drop("plain", "seen")


def decide_assets(assets: DataFrame, visited: DataFrame, policy: str = "all", excluded_extensions=(), url: str = "url", kind: str = "asset_type") -> DataFrame:
    """Adds target and decision. Reasons in order: blank, scheme, visited, kind, extension. visited has one row for each url."""
    rows = assets.withColumn("target", U.normalise(F.col(url)))
    seen = visited.select(F.col("url").alias("target"), F.lit(True).alias("seen"))
    rows = rows.join(seen, "target", "left")
    reason = (
        F.when(F.coalesce(F.col("target"), F.lit("")) == "", "blank")
        .when(U.is_excluded_scheme(F.col("target")), "scheme")
        .when(F.col("seen").isNotNull(), "visited")
        .when(~wanted_kind(F.col(kind), policy), "kind")
        .when(U.has_excluded_extension(F.col("target"), excluded_extensions), "extension")
        .otherwise("admitted"))
    return rows.withColumn("decision", reason).drop("seen")


def new_urls(found: DataFrame, *known: DataFrame) -> DataFrame:
    """found (url, depth, seq) without the addresses of the known tables; of repeated ones the first by seq."""
    for table in known:
        found = found.join(table.select("url"), "url", "left_anti")
    return found.groupBy("url").agg(F.min_by("depth", "seq").alias("depth"), F.min("seq").alias("seq"))
