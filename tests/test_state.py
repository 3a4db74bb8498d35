"""Projects, settings, logs, archives, robots, streams, and crawls that stop and go on."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.config import CrawlConfig
from weftline import schemas
from weftline.operators import admission, crawl, robots, state
from weftline.sources import project, responses
from weftline.streaming import crawl_log


def test_config_round_trip(tmp_path):
    config = CrawlConfig(start_url="https://e.com", project_name="06/https://x", asset_filter="some", max_depth=3)
    assert config.asset_filter == "all" and config.project_name == "06_https___x"
    config.save(str(tmp_path / "c.json"))
    assert CrawlConfig.load(str(tmp_path / "c.json")) == config
    told = json.loads((tmp_path / "c.json").read_text()) | {"later": 1}
    assert CrawlConfig.from_dict(told) == config
    assert len(CrawlConfig().tracking_params) == 9


def test_project(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        project.Project.load(spark, root)
    made = project.Project.create(spark, root, CrawlConfig(start_url="https://e.com", project_name="日本"))
    made.save(url_map=spark.createDataFrame([("u", "pages/u.html")], "url string, local_path string"), frontier=crawl.seed(spark, ["https://e.com/next"]))
    project.Project.create(spark, root, CrawlConfig(start_url="https://e.com", project_name="日本"))
    again = project.Project.load(spark, root)
    assert again.config().project_name == "日本" and again.table("url_map").count() == 1 and again.table("frontier").first().url == "https://e.com/next"
    assert again.table("visited").count() == 0 and again.log().count() == 0
    for k in range(2):
        again.append_log(spark.createDataFrame([(k, "visited", f"u{k}", "p", None, 1.0 + k)], "seq bigint, action string, url string, local_path string, error string, timestamp double"))
    assert again.log().count() == 2
    summary = state.summarise(again.log())
    assert summary.first().visited == 2 and summary.first().elapsed == 1.0


def test_stop_and_resume(spark):
    links = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "d"), ("d", 0, "a")], "src_url string, ordinal int, url string")
    whole = crawl.crawl(crawl.seed(spark, ["a"]), links)
    part = crawl.crawl(crawl.seed(spark, ["a"]), links, should_stop=lambda level: level == 2)
    rest = crawl.crawl(part.frontier, links, visited=part.visited, failed=part.failed)
    of = lambda c: sorted((r.url, r.depth) for r in c.visited.collect())
    assert of(whole) == of(rest) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert of(part) == [("a", 0), ("b", 1)]
    assert crawl.crawl(crawl.seed(spark, ["a"]), links, max_depth=1).visited.count() == 2


def test_failures_and_retry(spark):
    links = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c")], "src_url string, ordinal int, url string")
    replies = spark.createDataFrame([("a", "a", 200, "text/html"), ("b", None, 500, None)], "url string, final_url string, status int, content_type string")
    seen = []
    first = crawl.crawl(crawl.seed(spark, ["a"]), links, replies, progress=seen.append)
    assert sorted(r.url for r in first.failed.collect()) == ["b", "c"] and seen[-1]["failed"] == 2
    mended = replies.where("url = 'a'").unionByName(spark.createDataFrame([("b", "b2", 200, "image/png")], replies.schema))
    second = crawl.crawl(crawl.retry_failed(first.failed), links, mended, visited=first.visited)
    assert sorted(r.url for r in second.visited.collect()) == ["a", "b", "b2"] and [r.url for r in second.failed.collect()] == ["c"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: bot\nDisallow: /\n"
    rules = robots.parse_robots(spark.createDataFrame([("e.com", text), ("n.com", None), ("z.com", "")], "host string, text string"))
    urls = spark.createDataFrame([("https://e.com/a/b",), ("https://e.com/z",), ("https://o.com/a",), ("x",), (None,)], "url string")
    assert [r.robots_ok for r in robots.robots_filter(urls, rules).orderBy(F.col("url").desc()).collect()] == [True, True, True, False, True]
    assert {r.url: r.robots_ok for r in robots.robots_filter(urls, rules, "Bot/2").collect()}["https://e.com/z"] is False


def test_responses(spark):
    replies = spark.createDataFrame([("a", "a", 200, "text/html", b"x", None), ("b", "b", 404, "text/html", b"y", None), ("r", "r", 200, "text/html", b"z", "<p>")], "url string, final_url string, status int, content_type string, body binary, rendered_html string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("r",)], "url string")
    got = {r.url: (r.ok, r.text) for r in responses.fetch_pages(wanted, replies).collect()}
    assert got == {"a": (True, "x"), "b": (False, None), "c": (False, None), "r": (True, "<p>")}
    assert {r.url: r.bytes for r in responses.fetch_assets(wanted, replies).collect()} == {"a": 1, "b": None, "c": None, "r": 1}


def test_files_and_archives(spark, tmp_path):
    files = spark.createDataFrame([("pages/a.html", b"A"), ("assets/é.css", b"BB"), ("index.html", None)], "local_path string, body binary")
    assert project.export_files(files, f"file://{tmp_path}/out").agg(F.sum("bytes")).first()[0] == 3
    assert (tmp_path / "out/pages/a.html").read_bytes() == b"A" and (tmp_path / "out/index.html").read_bytes() == b""
    assert responses.read_bodies(spark, f"{tmp_path}/out").count() == 2
    names = [n for r in project.archive(files, most=1).collect() for n in zipfile.ZipFile(io.BytesIO(r.archive)).namelist()]
    assert sorted(names) == ["assets/é.css", "index.html", "pages/a.html"]
    project.write_zones(files.select("local_path", F.col("body").cast("string").alias("text")), f"{tmp_path}/zones")
    assert sorted(r.zone for r in spark.read.parquet(f"{tmp_path}/zones").select("zone").distinct().collect()) == ["assets", "index.html", "pages"]


def test_log_stream(spark, tmp_path):
    schema = "seq bigint, action string, url string, local_path string, error string, timestamp double"
    spark.createDataFrame([(k, "visited" if k % 2 else "failed", f"u{k % 3}", None, None, 60.0 * k) for k in range(6)], schema).write.json(f"{tmp_path}/log")
    got = []
    crawl_log.follow(crawl_log.read_log(spark, f"{tmp_path}/log"), lambda batch, _: got.append(batch.count()), f"{tmp_path}/check").awaitTermination(60)
    assert sum(got) == 6
    stream = crawl_log.latest_state(crawl_log.read_log(spark, f"{tmp_path}/log")).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    stream.processAllAvailable()
    stream.stop()
    assert {r.url: r.action for r in spark.sql("SELECT * FROM latest").collect()} == {"u0": "visited", "u1": "failed", "u2": "visited"}
    windows = crawl_log.windowed_counts(spark.read.schema(schema).json(f"{tmp_path}/log"))
    assert windows.agg(F.sum("entries")).first()[0] == 6


def test_stream_state_is_the_same_however_batches_repeat(spark, tmp_path):
    rows = [(k, "visited" if k % 3 else "failed", f"u{k % 7}", f"p{k}" if k % 3 else None, None if k % 3 else f"e{k}", 0.0) for k in range(60)]
    parts = [spark.createDataFrame(rows[k::5], schemas.LOG) for k in range(5)]
    held = crawl_log.UpsertedState(spark, f"{tmp_path}/state", deltas=2)
    assert held.entries().count() == 0
    for number, part in enumerate(parts):
        held(part, number)
        held(part, number)  # a driver that was lost runs its last batch again
    want = {}
    for _, action, url, path, error, _ in rows:
        want[action, url] = path if action == "visited" else error
    got = {("visited", r.url): r.local_path for r in held.url_map().collect()} | {("failed", r.url): r.error for r in held.errors().collect()}
    assert got == want
