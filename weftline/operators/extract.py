"""Links, assets and titles of pages, and assets of stylesheets, as tables.

A document is parsed once, in an Arrow function that sees only its id, address and text; what it found returns as
arrays, and the relational forms explode them. Links of plain pages have a native form besides.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import prepare
from . import css, html

LINK = "struct<tag:string,attr:string,raw:string,url:string>"
ASSET = "struct<url:string,asset_type:string,source_tag:string,source_attr:string>"
_LINK = pa.struct([(n, pa.string()) for n in ("tag", "attr", "raw", "url")])
_ASSET = pa.struct([(n, pa.string()) for n in ("url", "asset_type", "source_tag", "source_attr")])


def _dicts(kind, rows):
    names = [f.name for f in kind]
    return [None if r is None else [dict(zip(names, x, strict=True)) for x in r] for r in rows]


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, url, title, links and assets of each page; nulls where the text is null. Columns other than these go."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(text).alias("html"))

    def one(address, page):
        if page is None:
            return None, None, None
        read = html.read(page)
        base = html.base_of(read, address or "")
        return read.title, html.links(read, base), html.assets(read, page, base)

    def run(batches):
        for batch in batches:
            found = [one(*x) for x in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("url"), pa.array([x[0] for x in found], pa.string()),
                pa.array(_dicts(_LINK, [x[1] for x in found]), pa.list_(_LINK)), pa.array(_dicts(_ASSET, [x[2] for x in found]), pa.list_(_ASSET)),
            ], names=["key", "url", "title", "links", "assets"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, url string, title string, links array<{LINK}>, assets array<{ASSET}>").withColumnRenamed("key", key)


def links_of(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ordinal (from 0), tag, attr, raw, url of each link, in the extractors' order."""
    return parsed.select(key, F.posexplode("links").alias("ordinal", "link")).select(key, "ordinal", "link.*")


def assets_of(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ordinal (from 0), url, asset_type, source_tag, source_attr of each asset."""
    return parsed.select(key, F.posexplode("assets").alias("ordinal", "asset")).select(key, "ordinal", "asset.*")


def parse_stylesheets(sheets: DataFrame, key: str = "page_id", url: str = "css_url", text: str = "css") -> DataFrame:
    """key, ordinal, url, asset_type, source_tag, source_attr of each reference of each stylesheet."""
    prepare(sheets.sparkSession)
    rows = sheets.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(text).alias("css"))

    def run(batches):
        for batch in batches:
            found = [css.assets(c or "", u or "") for u, c in zip(batch.column("url").to_pylist(), batch.column("css").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_dicts(_ASSET, found), pa.list_(_ASSET))], names=["key", "assets"])

    parsed = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, assets array<{ASSET}>").withColumnRenamed("key", key)
    return assets_of(parsed, key)


#: An anchor's href in double or single quotes, or bare; comments and scripts are not told apart from content.
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def anchors(text: Column) -> Column:
    """Raw hrefs of the anchors of plain pages, on the JVM."""
    found = [F.regexp_extract_all(text, F.lit(_ANCHOR), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[f.alias(f"h{k}") for k, f in enumerate(found)]), lambda z: F.concat(*(F.coalesce(z[f"h{k}"], F.lit("")) for k in range(3))))


def anchor_links(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, ordinal, raw and resolved url of each anchor, without Python; for pages that need no parser."""
    raw = pages.select(F.col(key), F.col(url).alias("base"), F.posexplode(anchors(F.col(text))).alias("ordinal", "raw"))
    plain = raw.withColumn("raw", F.replace(F.col("raw"), F.lit("&amp;"), F.lit("&")))
    return plain.select(key, "ordinal", "raw", U.reference(F.col("raw"), F.col("base")).alias("url")).where("url IS NOT NULL")
