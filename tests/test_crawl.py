"""The crawl against a plain queue, over random sites with redirects, and after a driver that was lost."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl
from weftline.session import read_records, write_record

from .helpers import plain_crawl

REPLY = "url string, final_url string, status int, content_type string"
LINK = "src_url string, ordinal int, url string"


def frames(spark, replies, links):
    told = spark.createDataFrame([(u, *r) for u, r in replies.items()], REPLY)
    rows = [(p, k, u) for p, found in links.items() for k, u in enumerate(found)]
    return spark.createDataFrame(rows, LINK), told


def check(spark, starts, replies, links, max_depth=10):
    edges, told = frames(spark, replies, links)
    got = crawl.crawl(crawl.seed(spark, starts), edges, told, max_depth)
    visited, failed = plain_crawl(starts, replies, links, max_depth)
    assert sorted((r.url, r.depth, r.source) for r in got.visited.collect()) == sorted((u, *v) for u, v in visited.items())
    assert sorted((r.url, r.depth) for r in got.failed.collect()) == sorted(failed.items())
    # The order of discovery is one number, and that of the queue.
    order = [r.url for r in got.visited.where("source = url").orderBy("seq").collect()]
    assert order == [u for u, (_, s) in visited.items() if u == s]
    return got


def page(final=None, status=200, kind="text/html"):
    return final, status, kind


def test_an_address_that_an_earlier_one_redirects_to_is_not_asked_for(spark):
    links = {"0": ["a", "b"], "b": ["c"]}
    got = check(spark, ["0"], {"0": page(), "a": page("b"), "b": page(status=404), "c": page()}, links)
    assert got.failed.count() == 0 and got.visited.where("url = 'b'").first().source == "a"
    # The other way round b has been asked for before.
    got = check(spark, ["0"], {"0": page(), "a": page("b"), "b": page(status=404), "c": page()}, {"0": ["b", "a"], "b": ["c"]})
    assert [r.url for r in got.failed.collect()] == ["b"] and got.visited.where("url = 'b'").count() == 1


def test_chains_within_a_level(spark):
    """1 to 2, 2 to 3 and so on: every other one is not asked for."""
    n = 12
    names = [str(k) for k in range(n + 1)]
    replies = {"start": page()} | {k: page(str(int(k) + 1)) for k in names[:-1]} | {str(n): page()}
    got = check(spark, ["start"], replies, {"start": names} | {k: ["t" + k] for k in names})
    asked = {int(r.url) for r in got.visited.where("source = url AND url <> 'start'").collect()}
    assert asked == set(range(0, n + 1, 2))
    # Backwards, each has been asked for before it is redirected to.
    got = check(spark, ["start"], replies, {"start": names[::-1]})
    assert got.visited.where("source = url").count() == n + 2


@pytest.mark.parametrize("seed", range(2))
def test_random_sites(spark, seed):
    rng = random.Random(seed)
    names = [f"u{k}" for k in range(60)]
    replies = {u: page(rng.choice(names) if rng.random() < 0.4 else rng.choice([u, None]), rng.choice([200] * 6 + [404, None]), rng.choice(["text/html"] * 5 + ["image/png"])) for u in names if rng.random() < 0.9}
    links = {u: [rng.choice(names + ["gone"]) for _ in range(rng.randrange(5))] for u in names}
    check(spark, ["u0", "u1", "u0"], replies | {"u0": page()}, links, rng.choice([2, 10]))


def test_skipped_settles_branches(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("y", "z")]
    got = crawl.skipped(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(r.url for r in got.collect()) == ["b", "c", "z"]
    assert crawl.skipped(spark.createDataFrame([], "src string, dst string")) is None


def test_links_of_a_page_with_very_many(spark, monkeypatch):
    monkeypatch.setattr(crawl, "HUB", 7)
    links = {"0": [f"n{k % 90}" for k in range(100)], "n3": ["n1", "z"]}
    names = {"0", "z", *links["0"]}
    check(spark, ["0"], {u: page() for u in names}, links)


class Lost(Exception):
    pass


def lose_at(level):
    seen = []

    def admit(found):
        seen.append(1)
        if len(seen) == level:
            raise Lost
        return found

    return admit


def test_a_crawl_goes_on_from_its_last_whole_level(spark, tmp_path):
    level = 2
    replies = {str(k): page(str(k + 1) if k % 5 == 0 else None, 404 if k % 7 == 6 else 200) for k in range(16)}
    links = {str(k): [str((2 * k + 1) % 16), str((2 * k + 2) % 16)] for k in range(16)}
    edges, told = frames(spark, replies, links)
    start = crawl.seed(spark, ["0"])
    state = f"{tmp_path}/state"
    with pytest.raises(Lost):
        crawl.crawl(start, edges, told, admit=lose_at(level), state=state)
    assert len(read_records(spark, f"{state}/levels")) == level
    # Parts without a record, and a record that was cut short, do not count.
    with open(f"{state}/levels/{level:06d}.json", "w") as out:
        out.write('{"level": 99, "front')
    rest = crawl.crawl(crawl.seed(spark, ["elsewhere"]), edges, told, state=state)
    whole = crawl.crawl(start, edges, told)
    for name in ("visited", "failed", "frontier"):
        rows = [sorted(map(tuple, getattr(c, name).collect())) for c in (rest, whole)]
        assert rows[0] == rows[1]
    assert rest.levels == whole.levels


DIES = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from weftline.operators import crawl
links = spark.createDataFrame([(str(k), 0, str(k + 1)) for k in range(6)], "src_url string, ordinal int, url string")
seen = []
def admit(found):
    seen.append(1)
    if len(seen) == 4:
        os._exit(9)
    return found
crawl.crawl(crawl.seed(spark, ["0"]), links, admit=admit, state={state!r})
"""


def test_a_driver_dies_in_the_middle_of_a_level(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    state = f"{tmp_path}/state"
    died = subprocess.run([sys.executable, "-c", DIES.format(root=root, state=state)], cwd=tmp_path, timeout=200, capture_output=True)
    assert died.returncode == 9
    links = spark.createDataFrame([(str(k), 0, str(k + 1)) for k in range(6)], LINK)
    found = crawl.crawl(crawl.seed(spark, ["0"]), links, state=state)
    assert [(r.url, r.depth, r.seq) for r in found.visited.orderBy("seq").collect()] == [(str(k), k, k) for k in range(7)]


def test_a_level_writes_what_it_has_found(spark, tmp_path):
    """A chain after a wide level: the parts of later levels do not hold the wide one again."""
    links = [("0", k, f"w{k}") for k in range(2_000)] + [("w0", 0, "c1")] + [(f"c{k}", 0, f"c{k + 1}") for k in range(1, 4)]
    state = f"{tmp_path}/state"
    crawl.crawl(crawl.seed(spark, ["0"]), spark.createDataFrame(links, LINK), state=state)
    rows = {}
    for name in os.listdir(f"{state}/parts"):
        level = int(name.split("-")[0])
        rows[level] = rows.get(level, 0) + spark.read.schema("url string").parquet(f"{state}/parts/{name}").count()
    assert rows == {0: 1, 1: 2_000, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}


def test_earlier_frontiers_and_links_are_not_moved(spark):
    links = spark.createDataFrame([(str(k), 0, str(2 * k + j)) for k in range(500) for j in (0, 1)], LINK)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    try:
        def admit(found):
            plans.append(found._jdf.queryExecution().executedPlan().toString())
            return found
        crawl.crawl(crawl.seed(spark, ["1"]), links, max_depth=4, admit=admit)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Only the pages of the level are dealt out to the links' buckets.
    assert all(p.count("Exchange hashpartitioning") == 1 for p in plans)


def test_records(spark, tmp_path):
    assert read_records(spark, f"{tmp_path}/none") == {}
    write_record(spark, f"{tmp_path}/r/1.json", {"a": [1, 2]})
    write_record(spark, f"{tmp_path}/r/1.json", {"a": 3})
    assert read_records(spark, f"{tmp_path}/r") == {"1.json": {"a": 3}}


@pytest.mark.parametrize("part", [1 << 17, 90])
def test_in_order_numbers_any_partitions(spark, monkeypatch, part):
    monkeypatch.setattr(crawl, "ROWS_A_PART", part)
    rows = spark.range(1_000).select((F.col("id") * 7919 % 1_000).alias("v"), F.lit(1).alias("one")).repartition(7)
    out, n = crawl.in_order(rows, "one", "v")
    assert n == 1_000 and all(r.place == r.v + 1 for r in out.collect())
    out, n = crawl.in_order(rows.limit(0), "v")
    assert n == 0 and out.count() == 0


def test_stylesheets_in_a_circle(spark):
    sheets = spark.createDataFrame([(1, "http://e.com/a.css", "@import 'b.css'; a{b:url(a.png)}"), (2, "http://e.com/b.css", "@import 'a.css'; @import 'b.css'; a{b:url(b.png)}")], "page_id int, css_url string, css string")
    first = sheets.where("page_id = 1")
    of = lambda depth: sorted((r.url[13:], r.css_depth) for r in crawl.stylesheet_assets(first, depth, sheets).collect())
    assert of(1) == [("a.png", 1), ("b.css", 1)]
    assert of(2) == of(5) == of(50) == [("a.css", 2), ("a.png", 1), ("b.css", 1), ("b.css", 2), ("b.png", 2)]
