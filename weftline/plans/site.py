"""A whole crawl over recorded responses: traversal, assets, stylesheets, saved files with local references, state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import paths as P
from ..functions import urls as U
from ..functions.text import declare_utf8
from ..operators import admission, crawl, extract, rewrite, robots as robots_txt, state
from ..session import materialise
from ..sources.project import Project
from ..sources.responses import fetch_assets, fetch_pages


@dataclass
class Site:
    """visited (url, depth, seq), failed (url, error), url_map (url, local_path), blobs (sha256, canonical, copies),
    files (local_path, text: pages and stylesheets with local references), bodies (local_path, body: other assets,
    each distinct body under its canonical path), aliases (local_path, canonical), frontier, log and summary."""

    visited: DataFrame
    failed: DataFrame
    url_map: DataFrame
    blobs: DataFrame
    files: DataFrame
    bodies: DataFrame
    aliases: DataFrame
    frontier: DataFrame
    log: DataFrame
    summary: DataFrame

    def save(self, project: Project, config: CrawlConfig) -> None:
        """Into a project's tables; the log is appended, the rest overwritten."""
        project.save(self.summary, config, visited=self.visited, failed=self.failed, frontier=self.frontier, url_map=self.url_map, blobs=self.blobs)
        project.append_log(self.log)


def _admissible_links(parsed: DataFrame, start, config: CrawlConfig) -> DataFrame:
    """src_url, ordinal and url of the links that the policy admits, whatever has been visited."""
    links = extract.links_of(parsed.withColumnRenamed("url", "src_url"), "src_url").select("src_url", "ordinal", U.normalise(F.col("url")).alias("plain"))
    good = links.where((F.col("plain") != "") & ~U.is_excluded_scheme(F.col("plain")) & U.should_crawl(F.col("plain"), start, config.include_subdomains))
    good = good.where(~U.is_excluded_path(F.col("plain"), config.excluded_paths))
    target = U.strip_tracking(F.col("plain"), tuple(config.tracking_params)) if config.strip_tracking_params else F.col("plain")
    return good.select("src_url", "ordinal", target.alias("url"))


def _wanted_assets(assets: DataFrame, base: str, config: CrawlConfig) -> DataFrame:
    """Distinct addresses, with their kinds, of assets (url, asset_type, base) that the policy admits."""
    rows = assets.withColumn("url", U.normalise(F.col("url"), F.col(base)))
    nothing = rows.sparkSession.createDataFrame([], "url string")
    decided = admission.decide_assets(rows, nothing, config.asset_filter, config.excluded_extensions).where("decision = 'admitted'")
    return decided.groupBy(F.col("target").alias("url")).agg(F.max((F.col("asset_type") == "stylesheet").cast("int")).alias("sheet"))


def archive_site(spark: SparkSession, responses: DataFrame, config: CrawlConfig, robots: DataFrame | None = None, now: float = 0.0) -> Site:
    """Crawls responses (url, final_url, status, content_type, body) from the configured start.

    robots (host, text) is heeded for pages if the settings say so: what it denies fails like a missing response.
    Assets are fetched for visited pages, and for their stylesheets one level deep. Pages and stylesheets are rewritten
    once for each local path, against the final address; of several addresses with one path the last found is kept.
    """
    start = F.lit(config.start_url)
    recorded = responses.withColumn("url", U.normalise(F.col("url")))
    allowed = recorded
    if robots is not None and config.respect_robots:
        allowed = robots_txt.robots_filter(recorded, robots_txt.parse_robots(robots), config.user_agent).where("robots_ok").drop("robots_ok")
    fetched = fetch_pages(allowed.select("url"), allowed).where(F.col("ok") & F.contains("content_type", F.lit("text/html")))
    pages = materialise(fetched.select("url", "final_url", "text"))
    parsed = materialise(_parsed(pages))
    links = materialise(_admissible_links(parsed, start, config))
    final = U.normalise(F.col("final_url"))
    replies = allowed.select("url", F.when(final != "", final).otherwise(F.col("url")).alias("final_url"), "status", "content_type")
    first = spark.createDataFrame([(config.start_url,)], "raw string").select(U.normalise(F.col("raw")).alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"))
    found = crawl.crawl(first, links, replies, config.max_depth, links_of="url")

    saved = pages.join(found.visited.where("source = url"), "url").select("url", "final_url", "text", "seq", P.save_path(F.col("url"), start).alias("local_path"))
    saved = materialise(saved)
    aliases = saved.select(U.normalise(F.col("final_url")).alias("url"), "local_path", "seq").where("url <> ''")
    page_map = saved.select("url", "local_path", "seq").unionByName(aliases)

    fetched_assets = spark.createDataFrame([], "url string, ok boolean, sha256 string, bytes bigint, body binary, error string, sheet int")
    if config.fetch_external_assets:
        refs = parsed.join(saved.select("url"), "url", "left_semi").select("base", F.explode("assets").alias("a")).select("base", "a.url", "a.asset_type")
        known = page_map.select("url")
        wanted = _wanted_assets(refs, "base", config).join(known, "url", "left_anti")
        direct = materialise(fetch_assets(wanted, recorded).join(wanted, "url"))
        sheets = direct.where("ok AND sheet = 1").select(F.col("url").alias("page_id"), F.col("url").alias("css_url"), F.decode("body", "UTF-8").alias("css"))
        inner = extract.parse_stylesheets(sheets).withColumnRenamed("page_id", "base")
        deeper = _wanted_assets(inner, "base", config).join(known, "url", "left_anti").join(direct.select("url"), "url", "left_anti")
        fetched_assets = materialise(direct.unionByName(fetch_assets(deeper, recorded).join(deeper, "url")))
    assets = fetched_assets.where("ok").withColumn("local_path", P.save_path(F.col("url"), start))

    last = F.lit(1 << 62)
    every = page_map.unionByName(assets.select("url", "local_path", last.alias("seq")))
    url_map = materialise(every.groupBy("url").agg(F.max_by("local_path", "seq").alias("local_path")))
    blobs = assets.groupBy("sha256").agg(F.min("local_path").alias("canonical"), F.count("*").alias("copies"))
    texts = saved.groupBy("local_path").agg(F.max_by(F.struct("final_url", "text"), "seq").alias("p")).select(
        "local_path", F.col("p.final_url").alias("base_url"), F.lit("html").alias("kind"), declare_utf8(F.col("p.text")).alias("text"))
    styles = assets.where(U.suffix(F.col("local_path")) == ".css").groupBy("local_path").agg(F.max_by(F.struct("url", "body"), "url").alias("p")).select(
        "local_path", F.col("p.url").alias("base_url"), F.lit("css").alias("kind"), F.decode("p.body", "UTF-8").alias("text"))
    both = texts.unionByName(styles)
    turned = both.where(P.is_rewritable(F.col("local_path")))
    kept = both.where(~P.is_rewritable(F.col("local_path"))).select("local_path", "text")
    files = rewrite.rewrite_files(turned, url_map.select("url", F.col("local_path").alias("target"))).unionByName(kept)
    others = assets.where(U.suffix(F.col("local_path")) != ".css")
    pairs = others.join(others.groupBy("sha256").agg(F.min("local_path").alias("canonical")), "sha256")
    bodies = pairs.where("local_path = canonical").dropDuplicates(["local_path"]).select("local_path", "body")
    failed = found.failed.unionByName(fetched_assets.where("NOT ok").select("url", F.lit(None).cast("int").alias("depth"), last.alias("seq"), "error"))

    seen = url_map.join(found.visited.select("url", "seq"), "url", "left").select("url", "local_path", F.lit(None).cast("string").alias("error"), F.lit("visited").alias("action"), F.coalesce("seq", last).alias("at"))
    lost = failed.select("url", F.lit(None).cast("string").alias("local_path"), "error", F.lit("failed").alias("action"), F.col("seq").alias("at"))
    entry = F.xxhash64("url", "action")  # a number for each entry that does not depend on how rows lie
    log = seen.unionByName(lost).select(entry.alias("seq"), "action", "url", "local_path", "error", F.lit(float(now)).alias("timestamp"))
    summary = state.summarise(log, found.frontier, blobs)
    return Site(found.visited, failed, url_map, blobs, files, bodies, pairs.where("local_path <> canonical").select("local_path", "canonical").distinct(), found.frontier, log, summary)


def _parsed(pages: DataFrame) -> DataFrame:
    """url, base (the final address), title, links and assets of each page."""
    keyed = pages.select(F.struct("url", "final_url").alias("key"), F.col("final_url").alias("at"), "text")
    out = extract.parse_pages(keyed, "key", "at", "text")
    return out.select(F.col("key.url").alias("url"), F.col("key.final_url").alias("base"), "title", "links", "assets")
