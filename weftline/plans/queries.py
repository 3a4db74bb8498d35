"""The queries over pages, documents and events by name, and DuckDB's SQL for them.

A name begins with the operators that it shows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import paths as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import admission, crawl, dedup, extract, patterns, rewrite, robots, state
from ..session import read_table
from ..sources import project, responses
from . import derived as D
from . import site

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_HREF = """regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)"""
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query("x2_links_per_host", f"""
    WITH a AS (SELECT {_HOST} AS host, unnest({_HREF}) AS raw FROM pages)
    SELECT host, count(*) AS links, count(DISTINCT raw) AS distinct_links FROM a GROUP BY host""")
def links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    raw = pages.select(U.hostname(F.col("url")).alias("host"), F.explode(extract.anchors(F.col("html"))).alias("raw"))
    return raw.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("raw").alias("distinct_links"))


_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), E' \\n\\t\\r')"


@query("x1_page_titles", f"""
    SELECT page_id, nullif(replace(replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query("u1_url_parts", rf"""
    SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return read_table(spark, sf_dir, "pages").select(
        "page_id", U.scheme(url).alias("scheme"), U.hostname(url).alias("host"), U.path(url).alias("path"), U.query(url).alias("query"), U.fragment(url).alias("fragment"))


@query("u1_url_normalise", rf"""
    SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END ||
        CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || list_aggregate(list_sort(string_split({_QUERY}, '&')), 'string_agg', '&') END AS normalised
    FROM pages""")
def url_normalise(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url")).alias("normalised"))


_NORMAL_CASES = {
    "dots": "HTTPS://User@Example{n}.COM:443//a/./b/../c{n}/?z=1&a={n}&m=x y&a=0#frag",
    "port": "http://Example.com:8080",
    "scheme": "mailto:someone{n}@example.com#x",
    "protocol": "//cdn.example.com/x{n}?b=&a=%7E*",
    "relative": "../up{n}/./x;p=1?q#f",
    "blank": "   ",
    "query": "?k={n}",
}
_NORMAL_EXPECTED = {
    "dots": "https://example{n}.com/a/c{n}/?a=0&a={n}&m=x+y&z=1",
    "port": "http://example.com:8080/",
    "scheme": "mailto:someone{n}@example.com#x",
    "protocol": "https://cdn.example.com/x{n}?a=~%2A&b=",
    "relative": "{h}/up{n}/x?q=",
    "blank": "",
    "query": "{h}/d/p?k={n}",
}


@query("u1_u11_normalise_cases", f"SELECT page_id, variant, url AS normalised FROM {D.variants_sql(_NORMAL_EXPECTED)}")
def normalise_cases(spark, sf_dir):
    rows = D.variants(spark, sf_dir, _NORMAL_CASES)
    return rows.select("page_id", "variant", U.normalise(F.col("url"), F.concat(F.expr(D.SITE), F.lit("/d/p"))).alias("normalised"))


_STRIPPED = rf"""CASE WHEN {_QUERY} = '' THEN url ELSE regexp_extract(url, '^([^?]*)', 1) ||
    coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: NOT starts_with(x, 'utm_source='))), 'string_agg', '&'), ''), '') ||
    regexp_extract(url, '(#.*)$', 1) END"""


@query("u9_strip_tracking", f"SELECT page_id, {_STRIPPED} AS stripped FROM pages")
def strip_tracking(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", U.strip_tracking(F.col("url")).alias("stripped"))


@query("a2_dedup_after_strip", f"""
    SELECT stripped, count(*) AS copies, min(page_id) AS first_id FROM (SELECT page_id, regexp_replace({_STRIPPED}, '#.*$', '') AS stripped FROM pages) GROUP BY stripped""")
def dedup_after_strip(spark, sf_dir):
    stripped = F.regexp_replace(U.strip_tracking(F.col("url")), "#.*$", "")
    return read_table(spark, sf_dir, "pages").groupBy(stripped.alias("stripped")).agg(F.count("*").alias("copies"), F.min("page_id").alias("first_id"))


@query("u11_link_resolve", rf"""
    WITH a AS (SELECT page_id, url, unnest({_HREF}) AS raw FROM pages)
    SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^[a-z]+:') THEN raw ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || raw END AS resolved
    FROM a WHERE NOT regexp_matches(raw, '^(#|mailto:|tel:|javascript:|data:)') AND raw <> ''""")
def link_resolve(spark, sf_dir):
    return extract.anchor_links(read_table(spark, sf_dir, "pages")).select("page_id", "raw", F.col("url").alias("resolved"))


@query("u2_u3_host_relation", rf"""
    WITH h AS (SELECT page_id, {_HOST} AS host FROM pages)
    SELECT a.page_id, a.host = b.host AS same, a.host = a.host AS with_port, true AS below, false AS above FROM h a JOIN h b ON b.page_id = a.page_id + 1""")
def host_relation(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    url = F.col("url")
    sub = F.concat(F.lit("http://www."), U.hostname(url), F.lit(":81/x"))
    with_port = F.concat(F.lit("ftp://"), F.upper(U.hostname(url)), F.lit(":99"))
    return pages.join(after, "page_id").select(
        "page_id", U.is_same_host(url, F.col("other")).alias("same"), U.is_same_host(url, with_port).alias("with_port"), U.is_subdomain(sub, url).alias("below"), U.is_subdomain(url, sub).alias("above"))


_LINKS = {
    "admitted": "/fresh{n}?utm_source=x&b=1&a=2#top", "blank": " ", "scheme": "mailto:x{n}@example.com", "policy": "https://elsewhere.example/{n}",
    "policy asset": "/pic{n}.png", "visited": "/seen{n}/?fbclid=1", "path": "/private/{n}", "subdomain": "https://www.site{n}.example/",
}


@query("f1_crawl_admission", f"""
    SELECT page_id, variant, CASE WHEN variant IN ('policy asset', 'subdomain') THEN 'policy' ELSE variant END AS decision,
        CASE variant WHEN 'admitted' THEN {D.SITE} || '/fresh' || page_id || '?a=2&b=1' WHEN 'visited' THEN {D.SITE} || '/seen' || page_id || '/' END AS target
    FROM {D.variants_sql(_LINKS)}""")
def crawl_admission(spark, sf_dir):
    site = F.expr(D.SITE)
    links = D.variants(spark, sf_dir, _LINKS)
    links = links.withColumn("url", F.when(F.trim("url") != "", U.resolve(F.col("url"), F.concat(site, F.lit("/")))).otherwise(F.col("url")))
    visited = D.ids(spark, sf_dir).select(D.filled("{h}/seen{n}/").alias("url"))
    out = admission.decide_links(links, F.concat(site, F.lit("/")), visited, excluded_paths=("/private/",))
    return out.select("page_id", "variant", "decision", F.when(F.col("variant").isin("admitted", "visited"), F.col("target")).alias("target"))


@query("f1_admission_counts", f"""
    SELECT CASE WHEN variant IN ('policy asset', 'subdomain') THEN 'policy' ELSE variant END AS decision, count(*) AS links FROM {D.variants_sql(_LINKS)} GROUP BY 1""")
def admission_counts(spark, sf_dir):
    return crawl_admission(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("links"))


_ASSETS = {
    "admitted": "/img{n}.png", "scheme": "ftp://x.example/{n}.png", "visited": "/seen{n}.css", "kind": "/app{n}.js", "extension": "/big{n}.tar.gz", "blank": "",
}


@query("f2_asset_admission", f"SELECT page_id, variant, variant AS decision FROM {D.variants_sql(_ASSETS)}")
def asset_admission(spark, sf_dir):
    rows = D.variants(spark, sf_dir, _ASSETS)
    rows = rows.withColumn("url", F.when(F.col("url") != "", U.resolve(F.col("url"), F.concat(F.expr(D.SITE), F.lit("/")))).otherwise(""))
    rows = rows.withColumn("asset_type", F.when(F.col("variant") == "kind", "script").otherwise("image"))
    visited = D.ids(spark, sf_dir).select(D.filled("{h}/seen{n}.css").alias("url"))
    return admission.decide_assets(rows, visited, "images", (".zip", ".tar.gz")).select("page_id", "variant", "decision")


_ENDS = ("", ".html", ".PNG", ".css", ".tar.gz", ".woff2", ".php", ".v2", ".mjs", "/", ".jpg/", ".png?x=1")
_END = "CASE page_id % 12 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDS)) + " END"


@query("u5_u13_t8_asset_classify", f"""
    WITH e AS (SELECT page_id, {_END} AS e FROM pages)
    SELECT page_id, e IN ('.PNG', '.css', '.tar.gz', '.woff2', '.mjs', '.jpg/', '.png?x=1') AS asset, e IN ('', '.html', '.php', '/') AS page,
        CASE WHEN e = '.PNG' THEN 'image' WHEN e = '.woff2' THEN 'font' ELSE 'other' END AS kind FROM e""")
def asset_classify(spark, sf_dir):
    url = F.concat(F.expr(D.SITE), F.lit("/a.b/f"), F.col("page_id").cast("string"), F.expr(_END))
    return D.ids(spark, sf_dir).withColumn("url", url).select(
        "page_id", U.is_asset(F.col("url")).alias("asset"), P.is_page(F.col("url")).alias("page"), T.guess_kind(F.col("url")).alias("kind"))


@query("u6_u10_schemes", f"""
    SELECT page_id, variant, variant IN ('mail', 'script', 'blob', 'ftp') AS excluded, variant IN ('mail', 'script', 'hash', 'empty') AS skipped
    FROM {D.variants_sql({"mail": " MAILTO:a@b", "script": "javascript:void(0)", "blob": "blob:x{n}", "ftp": "ftp://x", "hash": "#a{n}", "empty": " ", "page": "/x{n}"})}""")
def schemes(spark, sf_dir):
    rows = D.variants(spark, sf_dir, {"mail": " MAILTO:a@b", "script": "javascript:void(0)", "blob": "blob:x{n}", "ftp": "ftp://x", "hash": "#a{n}", "empty": " ", "page": "/x{n}"})
    return rows.select("page_id", "variant", U.is_excluded_scheme(F.col("url")).alias("excluded"), U.is_skipped(F.col("url")).alias("skipped"))


# The SQL of a saved path: pages without a dot in the last segment become folders.
_BARE = rf"trim(regexp_replace({_PATH}, '/+', '/', 'g'), '/')"
_MARK = f"CASE WHEN {_QUERY} = '' THEN '' ELSE '_q' || substr(sha256({_QUERY}), 1, 10) END"
_FILE = rf"""CASE WHEN {_BARE} = '' THEN 'index' || {_MARK} || '.html'
    WHEN regexp_matches({_BARE}, '\.[^/]*$') THEN regexp_replace(regexp_extract({_BARE}, '^(.*)\.[^.]*$', 1), '[<>:"|?*]', '_', 'g') || {_MARK} || '.' || regexp_extract({_BARE}, '\.([^.]*)$', 1)
    ELSE regexp_replace({_BARE}, '[<>:"|?*]', '_', 'g') || '/index' || {_MARK} || '.html' END"""
_START = "(SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' FROM pages ORDER BY page_id LIMIT 1)"
_SAVED = rf"""CASE WHEN {_HOST} <> (SELECT {_HOST} FROM pages ORDER BY page_id LIMIT 1) THEN 'external/' || {_HOST} || '/' || {_FILE}
    WHEN {_BARE} = '' THEN 'index.html' WHEN regexp_matches({_BARE}, '\.[^/]*$') AND NOT regexp_matches({_BARE}, '(?i)\.html?$') THEN 'assets/' || {_FILE}
    ELSE 'pages/' || {_FILE} END"""


@query("u7_t9_relative_file", f"SELECT page_id, {_FILE} AS file FROM pages")
def relative_file(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", P.relative_file(F.col("url")).alias("file"))


def _start(pages: DataFrame):
    """The first page's site, as a one-row table."""
    first = pages.agg(F.min_by("url", "page_id").alias("u"))
    return first.select(F.concat(U.scheme(F.col("u")), F.lit("://"), U.netloc(F.col("u")), F.lit("/")).alias("start"))


@query("u12_u14_save_path", f"SELECT page_id, {_SAVED} AS saved FROM pages")
def save_path(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.crossJoin(F.broadcast(_start(pages))).select("page_id", P.save_path(F.col("url"), F.col("start")).alias("saved"))  # one row


@query("u8_file_by_host", f"""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'pages/' ELSE 'external/' || {_HOST} || '/' END || {_FILE} AS file FROM pages""")
def file_by_host(spark, sf_dir):
    base = F.when(F.expr("page_id % 2 = 0"), F.upper(U.netloc(F.col("url")))).otherwise("other.example")
    return read_table(spark, sf_dir, "pages").select("page_id", P.file_by_host(F.col("url"), base).alias("file"))


@query("t9_query_hash", f"SELECT page_id, {_MARK} AS mark FROM pages")
def query_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", P.query_mark(U.query(F.col("url"))).alias("mark"))


@query("a3_save_path_collisions", f"""
    WITH s AS (SELECT page_id, url, {_FILE} AS local_path FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '#.*$', '') || '#again', {_FILE} FROM pages WHERE page_id % 3 = 0)
    SELECT local_path, count(DISTINCT url) AS urls, arg_max(url, page_id) AS winner FROM s GROUP BY local_path HAVING count(DISTINCT url) > 1""")
def save_path_collisions(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    again = pages.where("page_id % 3 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"))
    saved = pages.unionByName(again).select("url", P.relative_file(F.col("url")).alias("local_path"), F.col("page_id").alias("seq"))
    return dedup.path_collisions(saved)


@query("u15_relative_path", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../../assets/s' || page_id || '.css' WHEN 1 THEN 'b' || page_id || '.html' WHEN 2 THEN 'pages/x/index.html' ELSE '../c/d.png' END AS relative FROM pages""")
def relative_path(spark, sf_dir):
    here = F.expr("CASE page_id % 4 WHEN 0 THEN 'pages/about/index.html' WHEN 1 THEN 'pages/a.html' WHEN 2 THEN 'index.html' ELSE 'external/h/b/x.css' END")
    there = F.expr("CASE page_id % 4 WHEN 0 THEN concat('assets/s', page_id, '.css') WHEN 1 THEN concat('pages/b', page_id, '.html') WHEN 2 THEN 'pages/x/index.html' ELSE 'external/h/c/d.png' END")
    return D.ids(spark, sf_dir).select("page_id", P.relative_path(here, there).alias("relative"))


@query("t6_srcset_parse", """
    SELECT page_id, unnest(['/a' || page_id || '.png', 'b.png', 'data:image/png;base64', 'AAAA']) AS entry FROM pages""")
def srcset_parse(spark, sf_dir):
    text = F.concat(F.lit(" /a"), F.col("page_id").cast("string"), F.lit(".png 1x,b.png   2x , ,data:image/png;base64,AAAA 3x"))
    return D.ids(spark, sf_dir).select("page_id", F.explode(T.srcset_urls(text)).alias("entry"))


@query("x0_html_assets", f"""
    SELECT page_id, ordinal::BIGINT AS ordinal, {D.filled_sql()} AS url, asset_type, source_tag, source_attr
    FROM (SELECT page_id FROM pages), {D.values_sql(D.PAGE_ASSETS)} v(ordinal, asset_type, source_tag, source_attr, url)""")
def html_assets(spark, sf_dir):
    return extract.assets_of(extract.parse_pages(D.asset_pages(spark, sf_dir))).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("x0_html_links", f"""
    SELECT page_id, ordinal::BIGINT AS ordinal, tag, attr, {D.filled_sql('raw')} AS raw, {D.filled_sql()} AS url
    FROM (SELECT page_id FROM pages), {D.values_sql(D.PAGE_LINKS)} v(ordinal, tag, attr, raw, url)""")
def html_links(spark, sf_dir):
    return extract.links_of(extract.parse_pages(D.asset_pages(spark, sf_dir))).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("x0_parsed_titles", "SELECT page_id, 'Page ' || page_id || ' & more' AS title FROM pages")
def parsed_titles(spark, sf_dir):
    return extract.parse_pages(D.asset_pages(spark, sf_dir)).select("page_id", "title")


@query("x2_parsed_links", f"""
    WITH a AS (SELECT page_id, url, unnest({_HREF}) AS raw FROM pages)
    SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^[a-z]+:') THEN raw ELSE regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || raw END AS url
    FROM a WHERE NOT regexp_matches(raw, '^(#|mailto:|tel:|javascript:|data:)') AND raw <> ''""")
def parsed_links(spark, sf_dir):
    return extract.links_of(extract.parse_pages(read_table(spark, sf_dir, "pages"))).where("tag = 'a'").select("page_id", "raw", "url")


@query("x17_css_assets", f"""
    SELECT page_id, ordinal::BIGINT AS ordinal, {D.filled_sql()} AS url, asset_type, source_tag, source_attr
    FROM (SELECT page_id FROM pages), {D.values_sql(D.SHEET_ASSETS)} v(ordinal, asset_type, source_tag, source_attr, url)""")
def css_assets(spark, sf_dir):
    return extract.parse_stylesheets(D.asset_sheets(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("g3_stylesheet_expansion", f"""
    SELECT page_id, 1::BIGINT AS css_depth, {D.filled_sql()} AS url FROM (SELECT page_id FROM pages), {D.values_sql(D.SHEET_ASSETS)} v(ordinal, asset_type, source_tag, source_attr, url)
    UNION ALL SELECT page_id, 2, {D.SITE} || '/css/deep' || page_id || '.png' FROM pages""")
def stylesheet_expansion(spark, sf_dir):
    sheets = D.asset_sheets(spark, sf_dir)
    inner = D.ids(spark, sf_dir).select("page_id", D.filled("{h}/css/reset{n}.css").alias("css_url"), D.filled("a { b: url(deep{n}.png) }").alias("css"))
    found = crawl.stylesheet_assets(sheets, 2, sheets.unionByName(inner))
    return found.select("page_id", F.col("css_depth").cast("long").alias("css_depth"), "url")


@query("s5_asset_type_counts", f"""
    SELECT asset_type, count(*) AS assets FROM (SELECT page_id FROM pages), {D.values_sql(D.PAGE_ASSETS)} v(ordinal, asset_type, source_tag, source_attr, url) GROUP BY asset_type""")
def asset_type_counts(spark, sf_dir):
    return html_assets(spark, sf_dir).groupBy("asset_type").agg(F.count("*").alias("assets"))


@query("f3_asset_policy", f"""
    SELECT policy, count(*) AS assets FROM (SELECT page_id FROM pages), {D.values_sql(D.PAGE_ASSETS)} v(ordinal, asset_type, source_tag, source_attr, url), (VALUES ('all'), ('images'), ('css_js')) p(policy)
    WHERE policy = 'all' OR policy = 'images' AND asset_type IN ('image', 'icon') OR policy = 'css_js' AND asset_type IN ('stylesheet', 'script') GROUP BY policy""")
def asset_policy(spark, sf_dir):
    wanted = F.array(*(F.when(T.wanted_kind(F.col("asset_type"), p), F.lit(p)) for p in ("all", "images", "css_js", "none")))
    return html_assets(spark, sf_dir).select(F.explode(F.array_compact(wanted)).alias("policy")).groupBy("policy").agg(F.count("*").alias("assets"))


@query("u16_excluded_path", f"SELECT page_id, contains(url, 'ref=x') OR contains(url, '.html') AS excluded FROM pages")
def excluded_path(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", U.is_excluded_path(F.col("url"), ("ref=x", ".html")).alias("excluded"))


@query("j10_exclusion_patterns", "SELECT page_id, pattern FROM pages JOIN (VALUES ('ref=x'), ('.html'), ('utm_')) p(pattern) ON contains(url, pattern)")
def exclusion_patterns(spark, sf_dir):
    asked = spark.createDataFrame([("ref=x",), ("utm_",), (".html",)], "pattern string")
    return patterns.matches(read_table(spark, sf_dir, "pages"), asked, "page_id", "url")


@query("j10_growing_patterns", r"""
    WITH p AS (SELECT DISTINCT regexp_extract(url, '(/[a-z]+/\d+)', 1) AS pattern FROM pages)
    SELECT page_id, pattern FROM pages JOIN p ON contains(url, pattern) WHERE pattern <> ''""")
def growing_patterns(spark, sf_dir):
    """Paths of all pages, looked for in all addresses: each is in its own, and some begin others."""
    pages = read_table(spark, sf_dir, "pages")
    asked = pages.select(F.regexp_extract("url", r"(/[a-z]+/\d+)", 1).alias("pattern")).where("pattern <> ''")
    return patterns.matches(pages, asked, "page_id", "url")


@query("u17_excluded_extension", f"SELECT page_id, {_END} IN ('.tar.gz', '.PNG', '.png?x=1') AS excluded FROM pages")
def excluded_extension(spark, sf_dir):
    url = F.concat(F.lit("https://x.example/f"), F.expr(_END))
    return D.ids(spark, sf_dir).select("page_id", U.has_excluded_extension(url, (".tar.gz", ".png")).alias("excluded"))


@query("u18_robots_url", r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/robots.txt' AS robots FROM pages")
def robots_url(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", U.robots_url(F.col("url")).alias("robots"))


@query("u19_project_name", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '_' || lang || '_ ' || doc_id WHEN 1 THEN 'weftline_project' WHEN 2 THEN 'CON_' WHEN 3 THEN 'a_b_' || lang ELSE 'weftline_project' END AS name FROM documents""")
def project_name(spark, sf_dir):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('  ', source, '/', lang, ': ', doc_id, ' . ') WHEN 1 THEN '///' WHEN 2 THEN 'CON' WHEN 3 THEN concat('a|b?', lang) END")
    return read_table(spark, sf_dir, "documents").select("doc_id", P.project_name(raw).alias("name"))


@query("u20_start_url", "SELECT page_id, page_id % 3 <> 2 AS good FROM pages")
def start_url(spark, sf_dir):
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('https://', page_id) ELSE upper(url) END")
    return read_table(spark, sf_dir, "pages").select("page_id", U.is_start_url(raw).alias("good"))


@query("u21_text_list", "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS entries FROM documents")
def text_list(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("entries"))


_CHARSETS = ("text/html; charset=utf-8", "text/html;Charset=\"Shift_JIS\"", "text/html", "text/html; charset=x-sjis; q=1")


@query("t1_t2_t3_charset_detect", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 3 THEN 'cp932' END AS header, CASE page_id % 2 WHEN 0 THEN 'EUC-JP' ELSE 'cp932' END AS inner_name FROM pages""")
def charset_detect(spark, sf_dir):
    header = F.element_at(F.array(*map(F.lit, _CHARSETS)), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.when(F.expr("page_id % 2 = 0"), F.lit("<meta charset=EUC-JP>")).otherwise('<meta content="text/html; charset=MS_Kanji">').cast("binary")
    return D.ids(spark, sf_dir).select(
        "page_id", T.encoding_name(T.charset_of_header(header)).alias("header"), T.encoding_name(T.charset_of_bytes(body)).alias("inner_name"))


#: A Japanese greeting, in Shift-JIS and as text.
_GREETING = ("82B182F182C982BF82CD", "こんにちは")


@query("t4_charset_decode", f"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '{_GREETING[1]}' WHEN 2 THEN '<meta charset=sjis>{_GREETING[1]}' ELSE 'é' || page_id END AS decoded FROM pages""")
def charset_decode(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    body = F.expr(f"""CASE page_id % 4 WHEN 0 THEN encode(html, 'UTF-8') WHEN 1 THEN unhex('{_GREETING[0]}')
        WHEN 2 THEN concat(encode('<meta charset=sjis>', 'UTF-8'), unhex('{_GREETING[0]}')) ELSE encode(concat('é', page_id), 'ISO-8859-1') END""")
    header = F.expr("CASE page_id % 4 WHEN 1 THEN 'text/html; charset=Shift_JIS' WHEN 3 THEN 'text/html; charset=iso-8859-1' ELSE 'text/html' END")
    return pages.select("page_id", T.decode_body(body, header).alias("decoded"))


@query("t5_charset_fix", """SELECT page_id, regexp_replace(html, '(<meta charset=")[^"]*"', '\\1UTF-8"', 'gi') AS fixed FROM pages""")
def charset_fix(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.declare_utf8(F.col("html")).alias("fixed"))


_EQUIVS = {
    "both": '<meta charset="Shift_JIS"><META HTTP-EQUIV="Content-Type" content="text/html; charset=EUC-JP">{n}',
    "none": '<meta http-equiv="content-type" content="text/html">{n}', "ended": "<meta http-equiv=content-type content='text/html;'>{n}", "absent": "<p>charset={n}</p>",
    "before": '<meta content="text/html" http-equiv="Content-Type">{n}', "renamed": '<meta content="text/html; charset=x{n}" http-equiv="Content-Type">',
}
_FIXED = {
    "both": '<meta charset="UTF-8"><META HTTP-EQUIV="Content-Type" content="text/html; charset=UTF-8">{n}',
    "none": '<meta http-equiv="content-type" content="text/html; charset=UTF-8">{n}', "ended": "<meta http-equiv=content-type content='text/html; charset=UTF-8'>{n}", "absent": "<p>charset={n}</p>",
    "before": '<meta content="text/html" http-equiv="Content-Type">{n}', "renamed": '<meta content="text/html; charset=UTF-8" http-equiv="Content-Type">',
}


@query("t5_charset_declarations", f"SELECT page_id, variant, html AS fixed FROM {D.variants_sql(_FIXED, 'html')}")
def charset_declarations(spark, sf_dir):
    return D.variants(spark, sf_dir, _EQUIVS, "html").select("page_id", "variant", T.declare_utf8(F.col("html")).alias("fixed"))


@query("t10_a3_content_dedup", """
    SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS canonical, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_alias FROM documents""")
def content_dedup(spark, sf_dir):
    return dedup.alias_bodies(read_table(spark, sf_dir, "documents"), "doc_id", "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("a3_blobs", "SELECT sha256(text) AS sha256, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY text")
def blobs(spark, sf_dir):
    return dedup.canonical_blobs(read_table(spark, sf_dir, "documents"), "doc_id", "doc_id", "text")


_ROBOTS = "User-agent: we\nDisallow: /first\n\nUser-agent: *\nDisallow: /a # first\nAllow: /a/b\nDisallow: /*.pdf\nDisallow:\n\nUser-agent: weft\nUser-agent: other\nDisallow: /only\n"
_ASKED = {"deny": "{h}/a/b{n}", "open": "{h}/z{n}.pdf", "root": "{h}", "only": "{h}/only{n}", "first": "{h}/first/{n}", "elsewhere": "https://else.example/a"}


@query("f7_robots_filter", f"SELECT page_id, variant, variant <> 'deny' AS general, variant <> 'first' AS named, variant <> 'only' AS other FROM {D.variants_sql(_ASKED)}")
def robots_filter(spark, sf_dir):
    texts = D.ids(spark, sf_dir).select(U.hostname(F.expr(D.SITE)).alias("host"), F.lit(_ROBOTS).alias("text")).distinct()
    rules = robots.parse_robots(texts)
    general = robots.robots_filter(D.variants(spark, sf_dir, _ASKED), rules).withColumnRenamed("robots_ok", "general")
    # Two groups name Weft, and the first of them counts.
    named = robots.robots_filter(general, rules, "Weft/1.0").withColumnRenamed("robots_ok", "named")
    other = robots.robots_filter(named, rules, "Other/2").withColumnRenamed("robots_ok", "other")
    return other.select("page_id", "variant", "general", "named", "other")


#: A group that an empty line ends, one with a delay alone, escapes and parameters.
_ROBOTS_STATES = (
    "User-agent: lost\n\nDisallow: /lost\nUser-agent: slow\nCrawl-delay: 2\nUser-agent: bot\nDisallow: /p;v=1\nDisallow: /%7Ejoe\n"
    "Allow: /caf%C3%A9/open\nDisallow: /caf\u00e9\n\nUser-agent: *\nDisallow: /all\n")
_ASKED_STATES = {"lost": "{h}/lost/{n}", "parameter": "{h}/p;v=1{n}", "joe": "{h}/~joe/{n}", "cafe": "{h}/caf\u00e9/{n}", "open": "{h}/caf%c3%a9/open{n}", "all": "{h}/%61ll/{n}"}


@query("f7_robots_states", f"SELECT page_id, variant, variant NOT IN ('parameter', 'joe', 'cafe') AS bot, true AS slow, variant <> 'all' AS lost FROM {D.variants_sql(_ASKED_STATES)}")
def robots_states(spark, sf_dir):
    rules = robots.parse_robots(D.ids(spark, sf_dir).select(U.hostname(F.expr(D.SITE)).alias("host"), F.lit(_ROBOTS_STATES).alias("text")).distinct())
    out = D.variants(spark, sf_dir, _ASKED_STATES)
    for agent in ("bot", "slow", "lost"):
        out = robots.robots_filter(out, rules, f"{agent}/1").withColumnRenamed("robots_ok", agent)
    return out.select("page_id", "variant", "bot", "slow", "lost")


_GRAPH_SQL = """
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
    e AS (SELECT page_id AS a, unnest([(2 * page_id + 1) % n, (2 * page_id + 2) % n, (7 * page_id + 3) % n]) AS b FROM pages, n),
    r(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT b, depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < 10)"""


@query("g1_bfs_depth", f"{_GRAPH_SQL} SELECT 'https://graph.example/' || id AS url, min(depth)::BIGINT AS depth FROM r GROUP BY id")
def bfs_depth(spark, sf_dir):
    _, links = D.graph(spark, sf_dir)
    found = crawl.crawl(crawl.seed(spark, ["https://graph.example/0"]), links)
    return found.visited.select("url", F.col("depth").cast("long").alias("depth"))


@query("g1_crawl_replay")
def crawl_replay(spark, sf_dir):
    """A crawl over recorded responses with failures, redirects and other content; tests hold it against a plain loop."""
    _, links = D.graph(spark, sf_dir)
    found = crawl.crawl(crawl.seed(spark, ["https://graph.example/0"]), links, D.responses(spark, sf_dir))
    both = found.visited.select("url", "depth", F.lit("visited").alias("action")).unionByName(found.failed.select("url", "depth", F.lit("failed").alias("action")))
    return both.withColumn("depth", F.col("depth").cast("long"))


@query("g10_redirect_chains", """
    WITH n AS (SELECT page_id AS i, count(*) OVER () AS n FROM pages),
    a AS (SELECT i, i % 4 IN (1, 2) AND i + 1 < n AS moves, i % 4 = 2 AS passed, i % 4 = 3 AND i % 3 = 0 AS broken FROM n WHERE i > 0)
    SELECT 'https://star.example/' || i AS url, 1::BIGINT AS depth, CASE WHEN broken THEN 'failed' ELSE 'visited' END AS action,
        CASE WHEN NOT broken THEN 'https://star.example/' || CASE WHEN passed THEN i - 1 ELSE i END END AS source FROM a
    UNION ALL SELECT 'https://star.example/0', 0, 'visited', 'https://star.example/0'""")
def redirect_chains(spark, sf_dir):
    """Page 0 links to all others in order. 1 redirects to 2, 2 would to 3, and so on by fours: 2 is not asked for, since 1
    has reached it, so neither its failure nor its redirect counts, and 3 is asked for."""
    at = lambda e: F.expr(f"concat('https://star.example/', {e})")
    nodes = D.ids(spark, sf_dir)
    last = nodes.count() - 1
    links = nodes.where("page_id > 0").select(at("0").alias("src_url"), F.col("page_id").alias("ordinal"), at("page_id").alias("url"))
    moved = f"page_id % 4 IN (1, 2) AND page_id < {last}"
    replies = nodes.select(
        at("page_id").alias("url"), F.when(F.expr(moved), at("page_id + 1")).otherwise(at("page_id")).alias("final_url"),
        F.expr("CASE WHEN page_id % 8 = 2 OR page_id % 4 = 3 AND page_id % 3 = 0 THEN 404 ELSE 200 END").alias("status"), F.lit("text/html").alias("content_type"))
    found = crawl.crawl(crawl.seed(spark, ["https://star.example/0"]), links, replies)
    both = found.visited.select("url", "depth", F.lit("visited").alias("action"), "source").unionByName(found.failed.select("url", "depth", F.lit("failed").alias("action"), F.lit(None).cast("string").alias("source")))
    return both.withColumn("depth", F.col("depth").cast("long"))


@query("j1_s6_frontier", f"""{_GRAPH_SQL}, v AS (SELECT DISTINCT id FROM r WHERE depth < 4)
    SELECT DISTINCT 'https://graph.example/' || b AS url FROM e WHERE a IN (SELECT id FROM v) AND b NOT IN (SELECT id FROM v) AND b % 5 <> 0""")
def frontier(spark, sf_dir):
    nodes, links = D.graph(spark, sf_dir)
    visited = crawl.crawl(crawl.seed(spark, ["https://graph.example/0"]), links, max_depth=3).visited
    failed = nodes.where(F.regexp_extract("url", r"(\d+)$", 1).cast("long") % 5 == 0)
    found = links.join(visited.select(F.col("url").alias("src_url"), "depth", "seq"), "src_url")
    found = found.select("url", "depth", F.array("seq", F.col("ordinal").cast("long")).alias("seq"))
    return admission.new_urls(found, visited, failed).select("url")


@query("s1_s2_frontier_order", "SELECT page_id, row_number() OVER (ORDER BY page_id % 4, page_id % 7, page_id) AS place FROM pages")
def frontier_order(spark, sf_dir):
    """The whole frontier in the order in which a queue gives it."""
    seq = F.array((F.col("page_id") % 7).cast("long"), F.col("page_id"))
    rows = D.ids(spark, sf_dir).select("page_id", D.filled("{h}/{n}").alias("url"), (F.col("page_id") % 4).cast("int").alias("depth"), seq.alias("seq"))
    return crawl.queue_order(rows).select("page_id", F.col("place").cast("long").alias("place"))


@query("s2_pop", "SELECT page_id FROM pages QUALIFY row_number() OVER (ORDER BY page_id % 4, page_id DESC) <= 10")
def pop(spark, sf_dir):
    """The ten addresses that a queue gives first."""
    rows = D.ids(spark, sf_dir).select("page_id", (F.col("page_id") % 4).cast("int").alias("depth"), F.array(-F.col("page_id")).alias("seq"))
    return crawl.pop(rows, 10).select("page_id")


@query("g5_g7_stop_resume", f"{_GRAPH_SQL} SELECT 'https://graph.example/' || id AS url, min(depth)::BIGINT AS depth FROM r GROUP BY id")
def stop_resume(spark, sf_dir):
    """A crawl that stops after three levels, is saved as a project and goes on from its tables."""
    from ..session import scratch_folder

    _, links = D.graph(spark, sf_dir)
    first = crawl.crawl(crawl.seed(spark, ["https://graph.example/0"]), links, should_stop=lambda level: level == 3)
    root = f"{scratch_folder(spark)}/project"
    project.Project.create(spark, root, CrawlConfig(start_url="https://graph.example/0", project_name="p")).save(visited=first.visited, failed=first.failed, frontier=first.frontier)
    saved = project.Project.load(spark, root)
    found = crawl.crawl(saved.table("frontier"), links, visited=saved.table("visited"), failed=saved.table("failed"))
    return found.visited.select("url", F.col("depth").cast("long").alias("depth"))


@query("j9_g10_redirect_aliases", f"SELECT DISTINCT alias, url FROM (SELECT url, unnest([url, final_url]) AS alias FROM {D.RESPONSES_SQL})")
def redirect_aliases(spark, sf_dir):
    return crawl.redirect_aliases(D.responses(spark, sf_dir))


@query("io1_fetch_pages", f"""
    SELECT w.url, r.status IS NOT NULL AND r.status < 400 AS ok, CASE WHEN r.status < 400 THEN r.body END AS text,
        CASE WHEN r.status IS NULL OR r.status >= 400 THEN 'Fetch returned None' END AS error
    FROM (SELECT 'https://graph.example/' || (page_id + 3) AS url FROM pages) w LEFT JOIN {D.RESPONSES_SQL} r USING (url)""")
def fetch_pages(spark, sf_dir):
    wanted = D.ids(spark, sf_dir).select(F.expr("concat('https://graph.example/', page_id + 3)").alias("url"))
    return responses.fetch_pages(wanted, D.responses(spark, sf_dir)).select("url", "ok", "text", "error")


@query("io2_fetch_assets", f"""
    SELECT w.url, coalesce(r.status < 400, false) AS ok, CASE WHEN r.status < 400 THEN sha256(r.body) END AS sha256, CASE WHEN r.status < 400 THEN strlen(r.body) ELSE 0 END AS bytes,
        CASE WHEN NOT coalesce(r.status < 400, false) THEN 'Asset download failed' END AS error
    FROM (SELECT 'https://graph.example/' || (page_id + 3) AS url FROM pages) w LEFT JOIN {D.RESPONSES_SQL} r USING (url)""")
def fetch_assets(spark, sf_dir):
    wanted = D.ids(spark, sf_dir).select(F.expr("concat('https://graph.example/', page_id + 3)").alias("url"))
    return responses.fetch_assets(wanted, D.responses(spark, sf_dir)).select("url", "ok", "sha256", F.coalesce("bytes", F.lit(0)).alias("bytes"), "error")


@query("f5_content_gate", f"SELECT content_type LIKE '%text/html%' AS page, count(*) AS responses FROM {D.RESPONSES_SQL} GROUP BY 1")
def content_gate(spark, sf_dir):
    return D.responses(spark, sf_dir).groupBy(crawl.is_page_type(F.col("content_type")).alias("page")).agg(F.count("*").alias("responses"))


@query("g8_a8_retry_failed", f"SELECT url, 0::BIGINT AS depth FROM {D.RESPONSES_SQL} WHERE status >= 400")
def retry_failed(spark, sf_dir):
    failed = D.responses(spark, sf_dir).where("status >= 400").select("url", F.lit(3).alias("depth"), F.lit(0).cast("long").alias("seq"))
    return crawl.retry_failed(failed).select("url", F.col("depth").cast("long").alias("depth"))


def _rewritten_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = D.asset_pages(spark, sf_dir).select(D.filled("pages/dir/p{n}.html").alias("local_path"), D.filled("{h}/b/").alias("base_url"), F.lit("html").alias("kind"), F.col("html").alias("text"))
    url_map = D.variants(spark, sf_dir, {"x": "{h}/b/x{n}.html", "img": "{h}/b/img{n}.png?x=1&y=2", "a": "{h}/b/a{n}.png", "bg": "{h}/b/bg{n}.png", "poster": "{h}/b/po{n}.jpg", "video": "{h}/b/v{n}.mp4", "frame": "{h}/b/fr{n}", "in": "{h}/b/in{n}.png",
        "script": "https://cdn.example.com/{n}.js", "sheet": "{h}/b/s{n}.css", "icon": "{h}/i.ico", "pre": "{h}/b/p{n}.woff2", "webp": "{h}/b/c{n}.webp", "ogg": "{h}/b/a{n}.ogg", "face": "{h}/b/f{n}.woff2"}).distinct()
    target = F.concat(F.when(F.col("variant") == "x", "pages/b/x").otherwise(F.concat(F.lit("assets/"), F.col("variant"))), F.when(F.col("variant") == "icon", "0").otherwise(F.col("page_id").cast("string")), F.lit(".f"))
    # All pages of a site share one icon.
    return files, url_map.select("url", target.alias("target")).distinct()


def _rewritten_text() -> str:
    text = D.PAGE.replace("Shift_JIS", "UTF-8").replace('"x{n}.html"', '"../b/x{n}.f"').replace('"img{n}.png?x=1&amp;y=2"', '"../../assets/img{n}.f"')
    text = text.replace("a{n}.png 1x, b{n}.png 2x", "../../assets/a{n}.f 1x, b{n}.png 2x").replace('url("bg{n}.png")', 'url("../../assets/bg{n}.f")')
    text = text.replace("'po{n}.jpg'", "'../../assets/poster{n}.f'").replace("src=v{n}.mp4", 'src="../../assets/video{n}.f"').replace('"fr{n}"', '"../../assets/frame{n}.f"')
    text = text.replace('"//cdn.example.com/{n}.js"', '"../../assets/script{n}.f"').replace('"s{n}.css"', '"../../assets/sheet{n}.f"').replace('"/i.ico"', '"../../assets/icon0.f"')
    text = text.replace('"p{n}.woff2"', '"../../assets/pre{n}.f"').replace('"c{n}.webp 1x"', '"../../assets/webp{n}.f 1x"').replace('"a{n}.ogg"', '"../../assets/ogg{n}.f"').replace("url(f{n}.woff2)", "url(../../assets/face{n}.f)")
    return text.replace("url('in{n}.png')", "url('../../assets/in{n}.f')").replace("'", "''")


@query("r1_r13_rewrite_pages", f"SELECT 'pages/dir/p' || page_id || '.html' AS local_path, {D.filled_sql(chr(39) + _rewritten_text() + chr(39))} AS text FROM pages")
def rewrite_pages(spark, sf_dir):
    files, url_map = _rewritten_pages(spark, sf_dir)
    return rewrite.rewrite_files(files, url_map)


@query("r14_j4_local_references", """
    SELECT 'pages/dir/p' || page_id || '.html' AS local_path, CASE WHEN v = 'x' THEN '../b/x' ELSE '../../assets/' || v END || CASE v WHEN 'icon' THEN 0 ELSE page_id END || '.f' AS relative
    FROM pages, (VALUES ('x'), ('img'), ('a'), ('bg'), ('poster'), ('video'), ('frame'), ('in'), ('script'), ('sheet'), ('icon'), ('pre'), ('webp'), ('ogg'), ('face')) t(v)""")
def local_references(spark, sf_dir):
    files, url_map = _rewritten_pages(spark, sf_dir)
    return rewrite.local_references(rewrite.find_references(files), url_map).select("local_path", "relative")


_SHEET_NEW = (
    D.SHEET.replace("url('reset{n}.css')", "url('../assets/reset{n}.css')").replace("'type{n}.css'", "'../assets/type{n}.css'").replace("url(/img/bg{n}.png)", "url(../assets/bg{n}.png)").replace("'", "''"))


@query("r12_css_rewrite", f"SELECT 'css/main' || page_id || '.css' AS local_path, {D.filled_sql(chr(39) + _SHEET_NEW + chr(39))} AS text FROM pages")
def css_rewrite(spark, sf_dir):
    files = D.asset_sheets(spark, sf_dir).select(D.filled("css/main{n}.css").alias("local_path"), F.col("css_url").alias("base_url"), F.lit("css").alias("kind"), F.col("css").alias("text"))
    url_map = D.variants(spark, sf_dir, {"reset": "{h}/css/reset{n}.css", "type": "{h}/css/type{n}.css", "bg": "{h}/img/bg{n}.png"})
    end = F.when(F.col("variant") == "bg", ".png").otherwise(".css")
    return rewrite.rewrite_files(files, url_map.select("url", F.concat(F.lit("assets/"), F.col("variant"), F.col("page_id").cast("string"), end).alias("target")))


@query("f6_a7_rewrite_targets", f"""
    SELECT count(*) AS files FROM (SELECT {_FILE} AS f FROM pages) WHERE regexp_matches(f, '(?i)\\.(html|htm|php|asp|aspx|jsp|cgi|shtml|xhtml|css)$')""")
def rewrite_targets(spark, sf_dir):
    saved = read_table(spark, sf_dir, "pages").select(P.relative_file(F.col("url")).alias("local_path"))
    return saved.where(P.is_rewritable(F.col("local_path"))).agg(F.count("*").alias("files"))


@query("f8_saved_files", f"SELECT url, body AS local_path FROM {D.RESPONSES_SQL} WHERE status < 400")
def saved_files(spark, sf_dir):
    """Entries of a URL map whose file was saved; a failed response has none."""
    replies = D.responses(spark, sf_dir)
    saved = responses.saved_pages(responses.fetch_pages(replies.select("url"), replies)).select(F.col("text").alias("local_path"))
    return rewrite.existing_files(replies.select("url", F.col("body").cast("string").alias("local_path")), saved).select("url", "local_path")


@query("j6_stylesheets", f"SELECT {D.SITE} || '/b/' || f || page_id || '.css' AS url, 'assets/' || f || page_id || '.css' AS local_path FROM pages, (VALUES ('s'), ('im')) v(f) WHERE page_id % 3 <> 1")
def stylesheets(spark, sf_dir):
    """Local paths of the stylesheets that pages name, linked or imported, among saved files."""
    saved = D.variants(spark, sf_dir, {"s": "{h}/b/s{n}.css", "im": "{h}/b/im{n}.css", "bg": "{h}/b/bg{n}.png", "none": "{h}/b/none{n}.css"}).where("page_id % 3 <> 1")
    local = F.concat(F.lit("assets/"), F.col("variant"), F.col("page_id").cast("string"), F.lit(".css"))
    return rewrite.saved_stylesheets(html_assets(spark, sf_dir), saved.select("url", local.alias("local_path")))


@query("a4_crawl_log_latest", f"SELECT url, arg_max(local_path, seq) AS local_path FROM {D.LOG_SQL} WHERE action = 'visited' GROUP BY url")
def crawl_log_latest(spark, sf_dir):
    return state.latest_url_map(D.crawl_log(spark, sf_dir))


@query("io6_stream_state", f"""
    SELECT 'visited' AS action, url, arg_max(local_path, seq) AS value FROM {D.LOG_SQL} WHERE action = 'visited' GROUP BY url
    UNION ALL SELECT 'failed', url, arg_max(error, seq) FROM {D.LOG_SQL} WHERE action = 'failed' GROUP BY url""")
def stream_state(spark, sf_dir):
    """The log appended in three parts and followed as a stream, which is started anew for each; the second part is lost
    on its way once, after its rows were written and before the stream had recorded it."""
    from ..session import scratch_folder
    from ..streaming.crawl_log import UpsertedState, follow, read_log

    root = scratch_folder(spark)
    held, log = UpsertedState(spark, f"{root}/state", deltas=2), D.crawl_log(spark, sf_dir)
    for part in range(3):
        log.where(F.col("seq") % 3 == part).write.mode("append").json(f"{root}/log")
        if part == 1:
            def lost(batch, number):
                held(batch, number)
                raise RuntimeError("lost")

            with contextlib.suppress(StreamingQueryException):
                follow(read_log(spark, f"{root}/log"), lost, f"{root}/checkpoint").awaitTermination()
        follow(read_log(spark, f"{root}/log"), held, f"{root}/checkpoint").awaitTermination()
    visited = held.url_map().select(F.lit("visited").alias("action"), "url", F.col("local_path").alias("value"))
    return visited.unionByName(held.errors().select(F.lit("failed").alias("action"), "url", F.col("error").alias("value")))


@query("a5_errors_latest", f"SELECT url, arg_max(error, seq) AS error FROM {D.LOG_SQL} WHERE action = 'failed' GROUP BY url")
def errors_latest(spark, sf_dir):
    return state.latest_errors(D.crawl_log(spark, sf_dir))


@query("a1_t13_crawl_summary", f"""
    SELECT count(DISTINCT url) FILTER (action = 'visited') AS visited, count(DISTINCT url) FILTER (action = 'failed') AS failed, (SELECT count(*) FROM pages) AS pending,
        (SELECT count(DISTINCT text) FROM documents) AS blobs, round(max(timestamp * 1.001377) - min(timestamp * 1.001377), 2) AS elapsed, max(timestamp * 1.001377) AS timestamp FROM {D.LOG_SQL}""")
def crawl_summary(spark, sf_dir):
    pending = D.ids(spark, sf_dir).select(D.filled("{h}/{n}").alias("url"))
    log = D.crawl_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp") * F.lit(1.001377))  # seconds that need rounding
    return state.summarise(log, pending, blobs(spark, sf_dir))


@query("a6_t12_progress", f"""
    SELECT done, done + rest AS total, (100 * done // (done + rest))::BIGINT AS percent FROM (SELECT count(DISTINCT url) AS done FROM {D.LOG_SQL} WHERE action = 'visited'), (SELECT count(*) AS rest FROM pages)""")
def progress(spark, sf_dir):
    pending = D.ids(spark, sf_dir).select(D.filled("{h}/{n}").alias("url"))
    return state.progress(D.crawl_log(spark, sf_dir), pending).withColumn("percent", F.col("percent").cast("long"))


@query("s8_log_tail", f"SELECT seq, action FROM {D.LOG_SQL} ORDER BY seq DESC LIMIT 10000")
def log_tail(spark, sf_dir):
    return state.log_tail(D.crawl_log(spark, sf_dir)).select("seq", "action")


@query("io11_archive", "SELECT 'pages/' || page_id || '.html' AS local_path, sha256(html) AS sha256 FROM pages")
def archive(spark, sf_dir):
    """Every file, read back from the archives."""
    files = read_table(spark, sf_dir, "pages").select(D.filled("pages/{n}.html").alias("local_path"), F.col("html").alias("body"))
    return project.archived_files(project.archive(files, 1 << 16)).select("local_path", F.sha2("body", 256).alias("sha256"))


@query("io11_one_archive", "SELECT 'pages/' || page_id || '.html' AS local_path, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages")
def one_archive(spark, sf_dir):
    """Every file, read back from the one archive of all."""
    from ..session import scratch_folder
    from ..sources.archive import read_archive, write_archive

    files = read_table(spark, sf_dir, "pages").select(D.filled("pages/{n}.html").alias("local_path"), F.col("html").alias("body"))
    path = f"{scratch_folder(spark)}/project.zip"
    entries = write_archive(files, path, 1 << 20)
    return read_archive(entries, path).select("local_path", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


@query("io12_saved_pages", f"SELECT url, body AS text FROM {D.RESPONSES_SQL} WHERE status < 400")
def saved_pages(spark, sf_dir):
    replies = D.responses(spark, sf_dir)
    return responses.saved_pages(responses.fetch_pages(replies.select("url"), replies))


def _site(spark, sf_dir):
    return site.archive_site(spark, D.site_responses(spark, sf_dir), CrawlConfig(start_url="https://graph.example/0"))


_SITE_SQL = f"""{_GRAPH_SQL}, p AS (SELECT DISTINCT id FROM r)
    SELECT 'https://graph.example/' || id AS url, CASE WHEN id = 0 THEN 'index.html' ELSE 'pages/' || id || '/index.html' END AS local_path FROM p
    UNION ALL SELECT DISTINCT 'https://graph.example/img/' || (id % 7) || '.png', 'assets/img/' || (id % 7) || '.png' FROM p
    UNION ALL SELECT 'https://graph.example/' || f, 'assets/' || f FROM (VALUES ('s.css'), ('bg.png')) x(f)"""


@query("g2_g12_site_url_map", _SITE_SQL)
def site_url_map(spark, sf_dir):
    return _site(spark, sf_dir).url_map


@query("g11_site_files", f"""{_GRAPH_SQL}, p AS (SELECT DISTINCT id FROM r),
    l AS (SELECT p.id, k, CASE WHEN t = 0 THEN up || 'index.html' WHEN t IN (SELECT id FROM p) THEN up || CASE WHEN p.id = 0 THEN 'pages/' ELSE '' END || t || '/index.html' ELSE 'https://graph.example/' || t END AS href
        FROM p, n, (VALUES (0, 2, 1), (1, 2, 2), (2, 7, 3)) v(k, a, b), LATERAL (SELECT (a * p.id + b) % n AS t), LATERAL (SELECT CASE WHEN p.id = 0 THEN '' WHEN t = 0 THEN '../../' ELSE '../' END AS up))
    SELECT CASE WHEN id = 0 THEN 'index.html' ELSE 'pages/' || id || '/index.html' END AS local_path, count(*) FILTER (href NOT LIKE 'https:%') AS local_links FROM l GROUP BY id
    UNION ALL SELECT 'assets/s.css', count(*) FROM (VALUES ('bg.png')) named(file)""")
def site_files(spark, sf_dir):
    """How many anchors of each rewritten file lead to other files; links with tracking parameters match in canonical form."""
    found = _site(spark, sf_dir)
    files = found.files.where("local_path NOT LIKE '%.css'").select("local_path", F.lit("html").alias("kind"), "text", F.lit("https://graph.example/0").alias("base_url"))
    again = rewrite.rewrite_files(files, found.url_map.select("url", F.col("local_path").alias("target")), match="normalized")
    count = F.size(F.filter(extract.anchors(F.col("text")), lambda h: F.endswith(h, F.lit("index.html")))).cast("long")
    links = again.select("local_path", count.alias("local_links"))
    # Of the stylesheet, the local files that it names and that were saved under the name it gives.
    named = F.transform(F.regexp_extract_all("text", F.lit(r"url\(([^):]+)\)"), F.lit(1)), lambda n: F.concat(F.lit("assets/"), n))
    sheets = found.files.where("local_path LIKE '%.css'").select("local_path", F.explode(named).alias("file"))
    saved = found.url_map.select(F.col("local_path").alias("file")).distinct()
    return links.unionByName(sheets.join(saved, "file", "left_semi").groupBy("local_path").agg(F.count("*").alias("local_links")))


@query("io9_io10_project_tables", "SELECT 'https://site' || (page_id % 5) || '.example/' || page_id AS url, 'pages/' || page_id || '.html' AS local_path FROM pages")
def project_tables(spark, sf_dir):
    """A URL map that went into a project's tables and came back."""
    from ..session import scratch_folder

    root = f"{scratch_folder(spark)}/project"
    made = project.Project.create(spark, root, CrawlConfig(start_url="https://site0.example/", project_name="p"))
    made.save(url_map=D.ids(spark, sf_dir).select(D.filled("{h}/{n}").alias("url"), D.filled("pages/{n}.html").alias("local_path")))
    return project.Project.load(spark, root).table("url_map")


def _saved_project(spark, sf_dir) -> project.Project:
    from ..session import scratch_folder

    root = f"{scratch_folder(spark)}/project"
    config = CrawlConfig.from_dict({"start_url": "https://site0.example/", "project_name": "a/b", "max_depth": 7, "asset_filter": "odd", "later_setting": 1})
    made = project.Project.create(spark, root, config)
    log = D.crawl_log(spark, sf_dir)
    failed = state.latest_errors(log).select("url", F.lit(2).alias("depth"), F.lit(1).cast("long").alias("seq"), "error")
    frontier = D.ids(spark, sf_dir).select(D.filled("{h}/{n}").alias("url"), F.lit(1).alias("depth"), F.col("page_id").alias("seq"))
    made.save(failed=failed, blobs=blobs(spark, sf_dir).withColumn("canonical", F.col("canonical").cast("string")), frontier=frontier)
    made.append_log(log)
    return project.Project.load(spark, root)


@query("io9_errors", f"SELECT url, arg_max(error, seq) AS error FROM {D.LOG_SQL} WHERE action = 'failed' GROUP BY url")
def project_errors(spark, sf_dir):
    """Errors that went into a project and came back."""
    return _saved_project(spark, sf_dir).table("failed").select("url", "error")


@query("io9_frontier", f"SELECT {D.SITE} || '/' || page_id AS url, 1::BIGINT AS depth FROM pages")
def project_frontier(spark, sf_dir):
    return _saved_project(spark, sf_dir).table("frontier").select("url", F.col("depth").cast("long").alias("depth"))


@query("io10_blobs", "SELECT sha256(text) AS sha256, min(doc_id)::VARCHAR AS canonical FROM documents GROUP BY text")
def project_blobs(spark, sf_dir):
    return _saved_project(spark, sf_dir).table("blobs").select("sha256", "canonical")


@query("io5_io6_log", f"SELECT seq, action, url FROM {D.LOG_SQL}")
def project_log(spark, sf_dir):
    """A crawl's log that was appended as JSON lines and read again."""
    return _saved_project(spark, sf_dir).log().select("seq", "action", "url")


@query("io7_s7_settings", "SELECT 'https://site0.example/' AS start_url, 'a_b' AS project_name, 7::BIGINT AS max_depth, 'all' AS asset_filter, 10::BIGINT AS default_depth")
def project_settings(spark, sf_dir):
    """Settings that were saved: unknown names are passed over, an unknown policy is all, the name is made safe."""
    config = _saved_project(spark, sf_dir).config()
    return spark.createDataFrame(
        [(config.start_url, config.project_name, config.max_depth, config.asset_filter, CrawlConfig().max_depth)], "start_url string, project_name string, max_depth long, asset_filter string, default_depth long")


@query("io7_s7_settings_table", """
    SELECT url AS start_url, CASE page_id % 3 WHEN 0 THEN 'a_b' || page_id WHEN 1 THEN 'CON_' ELSE 'weftline_project' END AS project_name,
        CASE WHEN page_id % 2 = 0 THEN page_id % 9 ELSE 10 END::BIGINT AS max_depth, CASE WHEN page_id % 4 = 1 THEN 'images' ELSE 'all' END AS asset_filter,
        page_id % 5 <> 0 AS respect_robots, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 5 END::BIGINT AS extensions FROM pages""")
def settings_table(spark, sf_dir):
    """Settings of a project for each page, written with names that are unknown, missing or null, and read again."""
    from ..session import scratch_folder

    told = F.struct(
        F.col("url").alias("start_url"), F.expr("CASE page_id % 3 WHEN 0 THEN concat('a/b', page_id) WHEN 1 THEN 'CON' END").alias("project_name"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN page_id % 9 END").alias("max_depth"), F.expr("CASE page_id % 4 WHEN 1 THEN 'images' WHEN 2 THEN 'everything' END").alias("asset_filter"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN false END").alias("respect_robots"), F.expr("CASE WHEN page_id % 7 = 0 THEN array('.zip') END").alias("excluded_extensions"), F.lit("x").alias("of_the_future"))
    path = f"{scratch_folder(spark)}/settings"
    read_table(spark, sf_dir, "pages").select(F.to_json(told).alias("value")).write.text(path)
    found = project.read_settings(spark, path)
    return found.select(
        "start_url", "project_name", F.col("max_depth").cast("long").alias("max_depth"), "asset_filter", "respect_robots", F.size("excluded_extensions").cast("long").alias("extensions"))


#: Elements that few pages have: frames, and sources outside pictures and media.
_RARE = {"frame": '<frameset><frame src="fr{n}.html"><frame name="x"></frameset>', "source": '<div><source src="s{n}.bin"></div>', "loose": '<source srcset="no{n}.png 1x">'}


@query("x4_x12_rare_elements", f"""
    SELECT page_id, 'frame' AS variant, 'frame' AS tag, 'page' AS kind, {D.SITE} || '/dir/fr' || page_id || '.html' AS url FROM pages
    UNION ALL SELECT page_id, 'source', 'source', 'other', {D.SITE} || '/dir/s' || page_id || '.bin' FROM pages""")
def rare_elements(spark, sf_dir):
    pages = D.variants(spark, sf_dir, _RARE, "html").select(F.struct("page_id", "variant").alias("key"), D.filled("{h}/dir/p{n}.html").alias("url"), "html")
    parsed = extract.parse_pages(pages, "key")
    found = extract.links_of(parsed, "key").select("key", "tag", F.lit("page").alias("kind"), "url")
    found = found.unionByName(extract.assets_of(parsed, "key").select("key", F.col("source_tag").alias("tag"), F.col("asset_type").alias("kind"), "url"))
    return found.select("key.page_id", "key.variant", "tag", "kind", "url")


@query("io3_rendered_pages", f"SELECT url, CASE WHEN page_id % 2 = 0 THEN '<i>' || page_id || '</i>' ELSE body END AS text FROM {D.RESPONSES_SQL} WHERE status < 400")
def rendered_pages(spark, sf_dir):
    """Pages whose rendered form was recorded have that as their text."""
    number = F.regexp_extract("url", r"(\d+)$", 1)
    replies = D.responses(spark, sf_dir).withColumn("rendered_html", F.when(number.cast("long") % 2 == 0, F.concat(F.lit("<i>"), number, F.lit("</i>"))))
    return responses.fetch_pages(replies.select("url"), replies).where("ok").select("url", "text")


@query("u4_subdomains", "SELECT page_id, page_id % 3 <> 2 AS taken FROM pages")
def subdomains(spark, sf_dir):
    """Links within a site and its subdomains are followed where the settings say so."""
    url = F.expr("CASE page_id % 3 WHEN 0 THEN 'https://example.com/a' WHEN 1 THEN 'https://sub.example.com/b' ELSE 'https://notexample.com/c' END")
    return D.ids(spark, sf_dir).select("page_id", U.should_crawl(url, F.lit("https://example.com/"), True).alias("taken"))


_FRAMES = {"frame": '<frameset><frame src="f{n}.htm"><frame src=\'none.htm\'></frameset>', "iframe": '<iframe src=f{n}.htm></iframe>'}
_FRAMED = {"frame": '<frameset><frame src="f{n}.html"><frame src=\'none.htm\'></frameset>', "iframe": '<iframe src="f{n}.html"></iframe>'}


@query("x4_r11_frames", f"SELECT variant || page_id AS local_path, html AS text FROM {D.variants_sql(_FRAMED, 'html')}")
def frames(spark, sf_dir):
    files = D.variants(spark, sf_dir, _FRAMES, "html").select(F.concat("variant", F.col("page_id").cast("string")).alias("local_path"), D.filled("{h}/").alias("base_url"), F.lit("html").alias("kind"), F.col("html").alias("text"))
    return rewrite.rewrite_files(files, D.ids(spark, sf_dir).select(D.filled("{h}/f{n}.htm").alias("url"), D.filled("f{n}.html").alias("target")))
