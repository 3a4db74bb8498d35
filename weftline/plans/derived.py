"""Tables that the pages table does not hold, made from page_id by formulas, so that SQL can tell the expected rows.

`{n}` stands for the page's id and `{h}` for its site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

SITE = "concat('https://site', page_id % 5, '.example')"

PAGE = (
    '<!DOCTYPE html><html><head><meta charset="Shift_JIS"><base href="/b/"><title> Page {n} &amp; more </title>'
    '<link rel="stylesheet" href="s{n}.css"><link rel="shortcut icon" href="/i.ico"><link rel="preload" href="p{n}.woff2">'
    '<script src="//cdn.example.com/{n}.js"></script>'
    '<style>@import "im{n}.css"; /* url(no.png) */ @font-face { src: url(f{n}.woff2) } .a { background: url("bg{n}.png") } '
    "@media print { .b { background: url(../m{n}.svg) } }</style></head><body>"
    '<a href="x{n}.html">x</a><a href="mailto:a@b.c">m</a><a href="#top">t</a><map><area href="/area{n}"></map><iframe src="fr{n}"></iframe>'
    '<img src="img{n}.png?x=1&amp;y=2" srcset="a{n}.png 1x, b{n}.png 2x"><picture><source srcset="c{n}.webp 1x"></picture>'
    "<video poster='po{n}.jpg'><source src=v{n}.mp4></video><audio><source src=\"a{n}.ogg\"></audio>"
    "<div style=\"background: url('in{n}.png')\"></div><meta http-equiv=\"Refresh\" content=\"5; URL='/r{n}'\"></body></html>"
)

#: (ordinal, asset_type, source_tag, source_attr, url) that PAGE holds.
PAGE_ASSETS = (
    (0, "image", "img", "src", "{h}/b/img{n}.png?x=1&y=2"),
    (1, "image", "img", "srcset", "{h}/b/a{n}.png"),
    (2, "image", "img", "srcset", "{h}/b/b{n}.png"),
    (3, "image", "source", "srcset", "{h}/b/c{n}.webp"),
    (4, "script", "script", "src", "https://cdn.example.com/{n}.js"),
    (5, "stylesheet", "link", "href", "{h}/b/s{n}.css"),
    (6, "icon", "link", "href", "{h}/i.ico"),
    (7, "video", "source", "src", "{h}/b/v{n}.mp4"),
    (8, "audio", "source", "src", "{h}/b/a{n}.ogg"),
    (9, "image", "video", "poster", "{h}/b/po{n}.jpg"),
    (10, "other", "link", "href", "{h}/b/p{n}.woff2"),
    (11, "stylesheet", "@import", "url", "{h}/b/im{n}.css"),
    (12, "font", "style", "url()", "{h}/b/f{n}.woff2"),
    (13, "image", "style", "url()", "{h}/b/bg{n}.png"),
    (14, "image", "style", "url()", "{h}/m{n}.svg"),
    (15, "image", "div", "style", "{h}/b/in{n}.png"),
)
PAGE_LINKS = (
    (0, "a", "href", "x{n}.html", "{h}/b/x{n}.html"),
    (1, "area", "href", "/area{n}", "{h}/area{n}"),
    (2, "iframe", "src", "fr{n}", "{h}/b/fr{n}"),
    (3, "meta", "content", "/r{n}", "{h}/r{n}"),
)

SHEET = (
    "@charset \"utf-8\"; @import url('reset{n}.css') screen; @import 'type{n}.css'; /* @import 'no.css'; */\n"
    "@font-face { font-family: 'F'; src: url(fonts/f{n}.woff2) format('woff2'), url( \"../f{n}.woff\" ) }\n"
    "body { background: url(/img/bg{n}.png) } .q::before { content: \"url(no.png)\" }\n"
    "@media (min-width: 1px) { @supports (display: grid) { .g { background-image: URL('g{n}.svg') } } .h { cursor: url(data:x), url(h{n}.cur) } }\n"
)
SHEET_ASSETS = (
    (0, "stylesheet", "@import", "url", "{h}/css/reset{n}.css"),
    (1, "stylesheet", "@import", "url", "{h}/css/type{n}.css"),
    (2, "font", "style", "url()", "{h}/css/fonts/f{n}.woff2"),
    (3, "font", "style", "url()", "{h}/f{n}.woff"),
    (4, "image", "style", "url()", "{h}/img/bg{n}.png"),
    (5, "image", "style", "url()", "{h}/css/g{n}.svg"),
    (6, "other", "style", "url()", "{h}/css/h{n}.cur"),
)


def filled(template: str | Column) -> Column:
    text = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(text, F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{h}"), F.expr(SITE))


def filled_sql(column: str = "url") -> str:
    """filled() for DuckDB."""
    return f"replace(replace({column}, '{{n}}', page_id::VARCHAR), '{{h}}', {SITE})"


def values_sql(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id")


def asset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).select("page_id", filled("{h}/dir/p{n}.html").alias("url"), filled(PAGE).alias("html"))


def asset_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spark, sf_dir).select("page_id", filled("{h}/css/main{n}.css").alias("css_url"), filled(SHEET).alias("css"))


def variants(spark: SparkSession, sf_dir: str, templates: dict[str, str], name: str = "url") -> DataFrame:
    """page_id, variant and a column with each template filled for each page."""
    entries = F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(t).alias(name)) for k, t in templates.items()))
    return ids(spark, sf_dir).select("page_id", F.explode(entries).alias("v")).select("page_id", "v.variant", filled(F.col(f"v.{name}")).alias(name))


def variants_sql(templates: dict[str, str], name: str = "url") -> str:
    return f"(SELECT page_id, variant, {filled_sql('t')} AS {name} FROM pages, {values_sql(list(templates.items()))} v(variant, t))"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links (src_url, ordinal, url): page i to (2i+1), (2i+2) and (7i+3) modulo the number of pages."""
    pages = ids(spark, sf_dir)
    n = pages.count()
    to = F.array(*(F.expr(f"({e}) % {n}") for e in ("2 * page_id + 1", "2 * page_id + 2", "7 * page_id + 3")))
    at = lambda c: F.concat(F.lit("https://graph.example/"), c.cast("string"))
    links = pages.select(at(F.col("page_id")).alias("src_url"), F.posexplode(to).alias("ordinal", "to")).select("src_url", "ordinal", at(F.col("to")).alias("url"))
    return pages.select(at(F.col("page_id")).alias("url")), links


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded response for each node of the graph: 404 where i % 11 = 5, a redirect to the next node where
    i % 13 = 0 (but for node 0), no page where i % 17 = 3."""
    pages = ids(spark, sf_dir)
    n = pages.count()
    at = lambda e: F.expr(f"concat('https://graph.example/', {e})")
    return pages.select(
        at("page_id").alias("url"), F.when(F.expr("page_id % 13 = 0 AND page_id > 0"), at(f"(page_id + 1) % {n}")).otherwise(at("page_id")).alias("final_url"),
        F.when(F.expr("page_id % 11 = 5"), 404).otherwise(200).alias("status"),
        F.when(F.expr("page_id % 17 = 3"), "image/png").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>")).cast("binary").alias("body"))


RESPONSES_SQL = """(SELECT page_id, 'https://graph.example/' || page_id AS url,
    'https://graph.example/' || CASE WHEN page_id % 13 = 0 AND page_id > 0 THEN (page_id + 1) % (SELECT count(*) FROM pages) ELSE page_id END AS final_url,
    CASE WHEN page_id % 11 = 5 THEN 404 ELSE 200 END AS status,
    CASE WHEN page_id % 17 = 3 THEN 'image/png' ELSE 'text/html; charset=utf-8' END AS content_type,
    '<p>' || page_id || '</p>' AS body FROM pages)"""


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log from the events: errors are failures, all else visits; 500 addresses."""
    events = read_table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"), F.expr("CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'failed' ELSE 'visited' END").alias("action"),
        F.expr("concat('https://log.example/', event_id * 31 % 500)").alias("url"),
        F.expr("CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL ELSE concat('pages/', event_id, '.html') END").alias("local_path"),
        F.expr("CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN concat('error ', event_id % 3) END").alias("error"),
        F.expr("cast(event_id AS double) * 0.25").alias("timestamp"))


LOG_SQL = """(SELECT event_id AS seq, CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'failed' ELSE 'visited' END AS action,
    'https://log.example/' || (event_id * 31 % 500) AS url,
    CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL ELSE 'pages/' || event_id || '.html' END AS local_path,
    CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'error ' || (event_id % 3) END AS error, event_id * 0.25::DOUBLE AS timestamp FROM events)"""


def site_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a site: each node a page with its three links, an image (one of seven) and a common stylesheet."""
    pages = ids(spark, sf_dir)
    n = pages.count()
    links = F.concat(*(F.concat(F.lit('<a href="/'), F.expr(f"({e}) % {n}").cast("string"), F.lit('?utm_source=s#x">l</a>')) for e in ("2 * page_id + 1", "2 * page_id + 2", "7 * page_id + 3")))
    html = F.concat(F.lit('<link rel="stylesheet" href="/s.css">'), links, F.lit('<img src="/img/'), F.expr("page_id % 7").cast("string"), F.lit('.png">'))
    at = lambda path: F.concat(F.lit("https://graph.example/"), path)
    fixed = lambda url, kind, body: (url, url, 200, kind, body)
    more = [fixed(f"https://graph.example/img/{k}.png", "image/png", f"picture {k // 2}".encode()) for k in range(7)]
    more += [fixed("https://graph.example/s.css", "text/css", b"a { b: url(bg.png) }"), fixed("https://graph.example/bg.png", "image/png", b"bg")]
    told = pages.select(at(F.col("page_id").cast("string")).alias("url"), at(F.col("page_id").cast("string")).alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), html.cast("binary").alias("body"))
    return told.unionByName(spark.createDataFrame(more, told.schema))
