"""Breadth-first traversal of a link graph, a level at a time, with a state that survives the driver.

Links and responses are bucketed by address once. A level's frontier is bucketed alike, so it meets both, and every earlier
frontier, without moving them: what a level shuffles and writes is what it has found. Parts of a level are written once,
under names of their own, and count from the moment that the level's record is written; what a lost driver leaves without a
record is never read. The order of discovery is one number, dense over the whole crawl.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import discard, materialise, read_records, scratch_folder, write_record
from .admission import new_urls

#: Links of one page that lie in one bucket; a page with more has several.
HUB = 10_000
#: Parts that hold the known addresses before they are merged.
RUNS = 12
#: Rows that one task numbers.
ROWS_A_PART = 1 << 17

_VISITED = "url string, depth int, seq bigint, source string"


@dataclass
class Crawl:
    """visited (url, depth, seq, source), failed (url, depth, seq, error) and the frontier (url, depth, seq) that is left.

    seq is the order of discovery. source is the address that was asked for: another one where url was reached by redirect.
    """

    visited: DataFrame
    failed: DataFrame
    frontier: DataFrame
    levels: int


@dataclass
class _State:
    """What a level's record tells: the parts that count, by path."""

    level: int = 0
    next_seq: int = 0
    buckets: int = 8
    deepest: int = 0
    frontier: str = ""
    known: list = field(default_factory=list)  # [path, rows] of all addresses that a frontier had
    visited: list = field(default_factory=list)
    failed: list = field(default_factory=list)
    aliased: list = field(default_factory=list)  # parts of visited with addresses that no frontier had
    pending: int = 0


def seed(spark: SparkSession, urls) -> DataFrame:
    return spark.createDataFrame([(u, 0, k) for k, u in enumerate(urls)], schemas.FRONTIER)


def _opened(spark: SparkSession, path: str, schema: str, keys: tuple, buckets: int) -> DataFrame:
    """A bucketed table by its files alone; the catalog's entry is dropped again, so sessions share nothing but the folder."""
    name, of = f"weftline_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({of}) SORTED BY ({of}) INTO {buckets} BUCKETS LOCATION '{path}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _bucketed(df: DataFrame, path: str, schema: str, keys: tuple, buckets: int) -> DataFrame:
    spark, name = df.sparkSession, f"weftline_{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = df.select(*columns).repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return _opened(spark, path, schema, keys, buckets)


def crawl(
    frontier: DataFrame, links: DataFrame, responses: DataFrame | None = None, max_depth: int = 10, admit: Callable[[DataFrame], DataFrame] | None = None,
    visited: DataFrame | None = None, failed: DataFrame | None = None, should_stop: Callable[[int], bool] | None = None, progress: Callable[[dict], None] | None = None,
    state: str | None = None, links_of: str = "final_url",
) -> Crawl:
    """Follows links (src_url, ordinal, url) from the frontier (url, depth, seq).

    responses (url, final_url, status, content_type) replays fetches: no response or a status from 400 on is a failure,
    and only text/html pages have their links followed; without the table every address is a page. A redirect counts both
    addresses as visited, in the order of discovery: an address that an earlier one of its level was redirected to is not
    asked for, so it neither fails nor redirects nor has its links followed. links_of says whether src_url is the address
    that was asked for ("url") or the one that answered ("final_url").

    A level beyond max_depth is neither visited nor failed. `admit` filters what a level found (url, depth, parent,
    ordinal). Of several finds of one address the first counts, by the finding page's seq and the link's ordinal. A stop
    leaves the frontier, and passing it on resumes the crawl. With `state`, a folder that all machines share, a crawl that
    was lost goes on from the last level that was complete; frontier, visited and failed are then those of the folder.
    """
    spark = frontier.sparkSession
    scratch = scratch_folder(spark)
    root = state or f"{scratch}/state"
    records = read_records(spark, f"{root}/levels")
    now = _State(**records[max(records)]) if records else _State(level=-1, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    opened: dict[tuple, DataFrame] = {}

    def table(path: str, schema: str) -> DataFrame:
        if (path, schema) not in opened:
            opened[path, schema] = _opened(spark, path, schema, ("url",), now.buckets)
        return opened[path, schema]

    def part(df: DataFrame, kind: str, schema: str) -> str:
        path = f"{root}/parts/{now.level + 1:06d}-{kind}-{uuid.uuid4().hex}"
        opened[path, schema] = _bucketed(df, path, schema, ("url",), now.buckets)
        return path

    def whole(paths: list, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def visited_of(now: _State) -> DataFrame:
        seen = whole(now.visited, _VISITED).withColumn("source", F.coalesce("source", "url"))
        if now.aliased:
            seen = seen.groupBy("url").agg(F.min(F.struct("seq", "depth", "source")).alias("v")).select("url", "v.depth", "v.seq", "v.source")
        return seen

    def commit() -> None:
        now.level += 1
        write_record(spark, f"{root}/levels/{now.level:06d}.json", asdict(now))

    if now.level < 0:
        first, highest = frontier, None
        if visited is not None:
            visited = visited.select("url", "depth", "seq", F.col("source") if "source" in visited.columns else F.col("url").alias("source"))
            now.visited.append(part(visited, "visited", _VISITED))
            highest = table(now.visited[0], _VISITED).agg(F.max("seq")).first()[0]
        if failed is not None:
            now.failed.append(part(failed, "failed", schemas.FAILED))
        before = [x for x in (visited, failed) if x is not None]
        for x in before:
            path = part(x, "known", "url string")
            now.known.append([path, table(path, "url string").count()])
        now.frontier = part(new_urls(first.where(F.col("depth") <= max_depth), *before), "frontier", schemas.FRONTIER)
        now.pending, last, deepest = table(now.frontier, schemas.FRONTIER).agg(F.count("*"), F.max("seq"), F.max("depth")).first()
        now.known.append([now.frontier, now.pending])
        now.deepest = deepest or 0
        now.next_seq = max([-1, *(s for s in (last, highest) if s is not None)]) + 1
        commit()

    outgoing = _Links(links, f"{scratch}/links", now.buckets)
    replies = None
    if responses is not None:
        told = responses.groupBy("url").agg(F.min(F.struct("final_url", "status", "content_type")).alias("r")).select("url", "r.final_url", "r.status", "r.content_type")
        replies = _bucketed(told, f"{scratch}/responses", "url string, final_url string, status int, content_type string", ("url",), now.buckets)

    while now.pending:
        if should_stop is not None and should_stop(now.level):
            break
        due = table(now.frontier, schemas.FRONTIER)
        if replies is not None:
            pages = _ask(due.where(F.col("depth") <= max_depth), replies, now, part, links_of)
        else:
            if now.deepest <= max_depth:
                now.visited.append(now.frontier)  # all that are due are visited, so the part serves as both
            else:
                due = due.where(F.col("depth") <= max_depth)
                now.visited.append(part(due.withColumn("source", F.col("url")), "visited", _VISITED))
            pages = due.select(F.col("url").alias("src_url"), "depth", "seq")
        found = outgoing.of(pages).select("url", (F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent"), "ordinal")
        if admit is not None:
            found = admit(found)
        new = found.where(F.col("depth") <= max_depth).groupBy("url").agg(F.min(F.struct("parent", "ordinal", "depth")).alias("f"))
        for path, _ in now.known:
            new = new.join(table(path, schemas.FRONTIER).select("url").hint("merge"), "url", "left_anti")
        if now.aliased:
            new = new.join(whole(now.aliased, _VISITED).where("source <> url").select("url"), "url", "left_anti")
        new = materialise(new.select("url", "f.depth", "f.parent", "f.ordinal"))
        numbered, now.pending = in_order(new, "parent", "ordinal")
        now.frontier = part(numbered.select("url", "depth", (F.col("place") - 1 + now.next_seq).alias("seq")), "frontier", schemas.FRONTIER)
        for done in (new, numbered):
            discard(done)
        now.known.append([now.frontier, now.pending])
        if len(now.known) > RUNS:  # all but the largest become one: a row is written again a number of times that grows with the logarithm
            *small, large = sorted(now.known, key=lambda r: r[1])
            path = part(spark.read.schema("url string").parquet(*(p for p, _ in small)), "known", "url string")
            now.known = [large, [path, sum(n for _, n in small)]]
        now.next_seq += now.pending
        now.deepest += 1
        commit()
        if progress is not None:
            progress({"level": now.level - 1, "visited": visited_of(now).count(), "pending": now.pending, "failed": whole(now.failed, schemas.FAILED).count()})
    return Crawl(visited_of(now), whole(now.failed, schemas.FAILED), whole([now.frontier], schemas.FRONTIER).where(F.lit(now.pending > 0)), now.level)


class _Links:
    """Links bucketed by page, those of a page with very many in blocks, so that no bucket grows with a page."""

    def __init__(self, links: DataFrame, path: str, buckets: int):
        rows = links.select("src_url", F.col("ordinal").cast("int").alias("ordinal"), "url", F.floor(F.col("ordinal") / HUB).cast("int").alias("block"))
        self.links = _bucketed(rows, path, "src_url string, block int, ordinal int, url string", ("src_url", "block"), buckets)
        hubs = materialise(self.links.where("block > 0").groupBy("src_url").agg(F.max("block").alias("blocks")))
        self.hubs = None if hubs.isEmpty() else hubs

    def of(self, pages: DataFrame) -> DataFrame:
        """pages (src_url, depth, seq) with ordinal and url of each of their links."""
        if self.hubs is None:
            blocks = pages.withColumn("block", F.lit(0))
        else:
            blocks = pages.join(self.hubs, "src_url", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(0))))).drop("blocks")
        return blocks.join(self.links.hint("merge"), ["src_url", "block"])


def _ask(due: DataFrame, replies: DataFrame, now: _State, part, links_of: str) -> DataFrame:
    """Writes what the level's addresses have become, and gives the pages (src_url, depth, seq) whose links are followed."""
    met = materialise(due.join(replies.hint("merge"), "url", "left"))
    moved = F.when((F.col("status") < 400) & (F.col("final_url") != F.col("url")), F.col("final_url"))
    aliases = met.select("url", "depth", "seq", moved.alias("alias")).where("alias IS NOT NULL")
    counted, aliased = met, not aliases.isEmpty()
    if aliased:
        later = met.select(F.col("url").alias("alias"), F.col("seq").alias("at"))
        edges = aliases.join(later, "alias").where("seq < at").select(F.col("url").alias("src"), F.col("alias").alias("dst"))
        dropped = skipped(edges)
        if dropped is not None:
            counted = materialise(met.join(dropped, "url", "left_anti"))
            aliases = aliases.join(dropped, "url", "left_anti")
    good = counted.where("status < 400")
    new = good.select("url", "depth", "seq", F.col("url").alias("source"))
    if aliased:
        also = aliases.groupBy(F.col("alias").alias("url")).agg(F.min(F.struct("seq", "depth", F.col("url").alias("source"))).alias("a")).select("url", "a.depth", "a.seq", "a.source")
        new = new.unionByName(also)  # some may be visited already; the first row of an address counts
    now.visited.append(part(new, "visited", _VISITED))
    if aliased:
        now.aliased.append(now.visited[-1])
    now.failed.append(part(counted.where("status IS NULL OR status >= 400").withColumn("error", F.lit("Fetch returned None")), "failed", schemas.FAILED))
    page = F.col("url") if links_of == "url" else F.coalesce("final_url", "url")
    return good.where(is_page_type(F.col("content_type"))).select(page.alias("src_url"), "depth", "seq")


def skipped(edges: DataFrame) -> DataFrame | None:
    """Of addresses that others redirect to (src before dst in the order of discovery), those that are not asked for: an
    address counts unless an earlier one that counts is redirected to it. url, or None if there are none.

    A round settles all addresses that no undecided one redirects to; a chain of n redirects takes about n / 2 rounds, over
    what is left of the edges alone.
    """
    edges = materialise(edges)
    dead = None
    while True:
        free = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        hit = materialise(free.select(F.col("dst").alias("url")).distinct())
        if hit.isEmpty():
            return dead
        dead = hit if dead is None else dead.unionByName(hit)
        left = edges.join(hit.select(F.col("url").alias("dst")), "dst", "left_anti").join(hit.select(F.col("url").alias("src")), "src", "left_anti")
        left = materialise(left)
        discard(edges)
        edges = left


def is_page_type(content_type: Column) -> Column:
    """Whether links of a response are followed."""
    return F.contains(content_type, F.lit("text/html"))


def in_order(rows: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """rows as a table with place, from 1 in ascending order of the columns, and their number.

    rows should be a table, since they are read more than once. They are dealt out by ranges of some ROWS_A_PART and numbered in their part as
    they are written; of each part only its number of rows goes to the driver.
    """
    total = rows.count()
    within = F.monotonically_increasing_id()  # the part, and below it the place in it
    if total <= ROWS_A_PART:
        return rows.coalesce(1).sortWithinPartitions(*by).withColumn("place", within + 1), total
    held = materialise(rows.repartitionByRange(-(-total // ROWS_A_PART), *by).sortWithinPartitions(*by).withColumn("within", within))
    of = F.shiftright("within", 33)
    counts = dict(held.groupBy(of.alias("part")).count().collect())
    before = [sum(n for part, n in counts.items() if part < k) for k in range(max(counts) + 1)]
    offset = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), of.cast("int"))
    out = held.withColumn("place", offset + F.col("within").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("within")
    out._weftline_path = held._weftline_path
    return out, total


def queue_order(frontier: DataFrame) -> DataFrame:
    """The frontier with place, 1 for the address that is taken first: by depth, then by the order of discovery."""
    return in_order(materialise(frontier), "depth", "seq")[0]


def pop(frontier: DataFrame, n: int) -> DataFrame:
    """The n addresses that are taken next; the whole frontier is what a level of crawl() takes."""
    return frontier.orderBy("depth", "seq").limit(n)


def retry_failed(failed: DataFrame) -> DataFrame:
    """Failed addresses as a frontier at depth 0, in their order; pass an emptied failed table on with it."""
    return failed.select("url", F.lit(0).alias("depth"), "seq")


def redirect_aliases(responses: DataFrame) -> DataFrame:
    """url and final_url of each response as two addresses of one body."""
    pair = F.array_distinct(F.array("url", F.coalesce("final_url", "url")))
    return responses.select(F.explode(pair).alias("alias"), "url")


def stylesheet_assets(sheets: DataFrame, css_depth: int = 1, saved: DataFrame | None = None) -> DataFrame:
    """Assets of stylesheets (page_id, css_url, css), followed through imports of saved ones (or of these), with css_depth.

    A sheet is parsed once, at the least depth that it is reached at, so imports that go round in a circle end by themselves
    at any css_depth.
    """
    from .extract import parse_stylesheets

    saved = (sheets if saved is None else saved).select(F.col("css_url").alias("url"), "page_id", "css")
    found, level = [], materialise(sheets.select("page_id", "css_url", "css"))
    seen = level.select("css_url")
    for depth in range(1, css_depth + 1):
        found.append(materialise(parse_stylesheets(level).withColumn("css_depth", F.lit(depth))))
        if depth == css_depth:
            break
        imported = found[-1].where("asset_type = 'stylesheet'").select(F.col("url").alias("css_url")).distinct().join(seen, "css_url", "left_anti")
        level = materialise(imported.join(saved.withColumnRenamed("url", "css_url"), "css_url").select("page_id", "css_url", "css"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("css_url"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
