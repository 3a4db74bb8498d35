"""Every registered query of the reference's operators against its SQL, and the entry module's contract."""

import pytest

from weftline.plans.queries import ORACLE_SQL, QUERIES

from .helpers import connect, plain_crawl, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def replayed(spark, sf_dir):
    """What a plain queue makes of the graph's recorded responses."""
    from weftline.config import CrawlConfig
    from weftline.plans import derived

    replies = {r.url: (r.final_url, r.status, r.content_type) for r in derived.responses(spark, sf_dir).collect()}
    links = {}
    for r in derived.graph(spark, sf_dir)[1].orderBy("src_url", "ordinal").collect():
        links.setdefault(r.src_url, []).append(r.url)
    visited, failed = plain_crawl(["https://graph.example/0"], replies, links, CrawlConfig(start_url="x").max_depth)
    return sorted([(u, d, "visited") for u, (d, _) in visited.items()] + [(u, d, "failed") for u, d in failed.items()])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_crawl_replay_equals_a_plain_queue(spark, folder):
    want = replayed(spark, folder)
    assert len(want) > 40 and max(d for _, d, _ in want) > 4
    assert sorted((r.url, r.depth, r.action) for r in QUERIES["g1_crawl_replay"](spark, folder).collect()) == want
