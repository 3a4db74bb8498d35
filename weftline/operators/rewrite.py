"""Replacing references in saved pages and stylesheets by paths of local files.

A text is read by Python once. What comes back is the text in pieces: what stands between the spans that may change, and
each span's addresses. Addresses are joined with the URL map, once each, so the work follows the references and not files
times map entries, and the pieces are put together again on the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.paths import relative_path
from ..functions.text import declare_utf8
from ..functions.urls import normalise, strip_tracking
from ..session import materialise, prepare
from . import css, html

_REF = pa.struct([("raw", pa.string()), ("url", pa.string())])
_PART = pa.struct([("before", pa.string()), ("at", pa.int32()), ("plain", pa.string()), ("open", pa.string()), ("close", pa.string())])
_PIECE = pa.struct([("before", pa.string()), ("original", pa.string()), ("quote", pa.string()), ("parts", pa.list_(_PART)), ("after", pa.string())])
_TAKEN = (
    "local_path string, refs array<struct<raw:string,url:string>>, pieces array<struct<before:string,original:string,quote:string,"
    "parts:array<struct<before:string,at:int,plain:string,open:string,close:string>>,after:string>>, rest string")


def taken_apart(files: DataFrame, base_element: bool = False) -> DataFrame:
    """local_path, refs (raw, url: the distinct addresses that may be replaced), pieces and rest of files (local_path,
    base_url, kind, text).

    A piece is the text before a span (before), the span as it is (original), and its parts, whose addresses are told by
    their places in refs, -1 for one that leads nowhere. A null text has no pieces and a null rest.
    """
    prepare(files.sparkSession)
    rows = files.select("local_path", "base_url", "kind", "text")

    def one(base, kind, text):
        if text is None:
            return [], [], None
        page = None if kind == "css" else html.read(text)
        found = html.css_edits(text, imports=True) if page is None else html.edits(page, text)
        base = html.base_of(page, base or "") if page is not None and base_element else base or ""
        refs, places, pieces, end = [], {}, [], 0
        for e in found:
            parts = []
            for p in e.parts:
                if p.raw not in places:
                    url = css.reference(p.raw, base)
                    places[p.raw] = -1 if url is None else len(refs)
                    if url is not None:
                        refs.append({"raw": p.raw, "url": url})
                parts.append({"before": p.before, "at": places[p.raw], "plain": p.plain, "open": p.open, "close": p.close})
            pieces.append({"before": text[end : e.start], "original": text[e.start : e.end], "quote": e.quote, "parts": parts, "after": e.after})
            end = e.end
        return refs, pieces, text[end:]

    def run(batches):
        for batch in batches:
            refs, pieces, rest = [], [], []
            for x in zip(*(batch.column(c).to_pylist() for c in ("base_url", "kind", "text")), strict=True):
                for column, value in zip((refs, pieces, rest), one(*x)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("local_path"), pa.array(refs, pa.list_(_REF)), pa.array(pieces, pa.list_(_PIECE)), pa.array(rest, pa.string())], names=["local_path", "refs", "pieces", "rest"])

    return rows.mapInArrow(run, _TAKEN)


def find_references(files: DataFrame, base_element: bool = False) -> DataFrame:
    """local_path, raw, url of what rewriting may replace in files (local_path, base_url, kind, text)."""
    return taken_apart(files, base_element).select("local_path", F.explode("refs").alias("ref")).select("local_path", "ref.*")


def put_together(pieces: Column, rest: Column, local: Column) -> Column:
    """The text of pieces, with the paths that local holds at the places of their addresses."""
    def escaped(value, quote):
        plain = F.replace(value, F.lit("&"), F.lit("&amp;"))
        return F.when(quote == "", value).when(quote == '"', F.replace(plain, F.lit('"'), F.lit("&quot;"))).otherwise(F.replace(plain, F.lit("'"), F.lit("&#x27;")))

    def span(p):
        part = lambda x: F.concat(x.before, F.coalesce(F.concat(x.open, escaped(F.get(local, x.at), p.quote), x.close), x.plain))
        changed = F.exists(p.parts, lambda x: F.get(local, x.at).isNotNull())
        return F.concat(p.before, F.when(changed, F.concat(F.array_join(F.transform(p.parts, part), ""), p.after)).otherwise(p.original))

    return F.concat(F.array_join(F.transform(pieces, span), ""), rest)


def local_references(refs: DataFrame, url_map: DataFrame, match: str = "exact", how: str = "inner") -> DataFrame:
    """refs (local_path, raw, url and other columns) with relative, the path to the file that the map (url, target) has
    for the address; `how` left keeps the others, with null. url is unique in the map.

    `match` is exact, or normalized: then both sides are compared in canonical form, without tracking parameters.
    """
    if match == "exact":
        joined = refs.join(url_map.select("url", "target"), "url", how)
    else:
        clean = lambda c: strip_tracking(normalise(F.col(c)))
        joined = refs.withColumn("at", clean("url")).join(url_map.select(clean("url").alias("at"), "target").groupBy("at").agg(F.min("target").alias("target")), "at", how)
    path = F.when(F.col("target").isNotNull(), relative_path(F.col("local_path"), F.col("target")))
    return joined.select("local_path", *(c for c in refs.columns if c not in ("local_path", "url")), path.alias("relative"))


def existing_files(mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a map (with local_path) whose file is among the saved ones (local_path)."""
    return mapped.join(files.select("local_path"), "local_path", "left_semi")


def saved_stylesheets(assets: DataFrame, url_map: DataFrame) -> DataFrame:
    """url and local_path of the stylesheets that assets (url, asset_type) name and the map (url, local_path) has."""
    return url_map.select("url", "local_path").join(assets.where("asset_type = 'stylesheet'").select("url"), "url", "left_semi")


def rewrite_files(files: DataFrame, url_map: DataFrame, match: str = "exact", base_element: bool = False) -> DataFrame:
    """local_path and text of every file, its references replaced; pages declare UTF-8.

    url_map has (url, target), with entries only for files that exist. With an empty map every text returns as it is.
    One row per local_path is expected, with the page's final address as its base.
    """
    mapped = F.broadcast(url_map.limit(1).select(F.lit(True).alias("mapped")))
    rows = files.select("local_path", "base_url", "kind", "text").join(mapped, F.lit(True), "left")
    declared = F.when(F.col("mapped").isNotNull() & (F.col("kind") != "css"), declare_utf8(F.col("text"))).otherwise(F.col("text"))
    # Two readers: the references, which take none of the texts, and the splice.
    parsed = materialise(taken_apart(rows.withColumn("text", declared), base_element))
    refs = parsed.select("local_path", F.posexplode("refs").alias("place", "ref")).select("local_path", "place", "ref.url")
    told = local_references(refs, url_map, match, "left")
    # Each place of refs has one entry, so its path stands at its place.
    found = told.groupBy("local_path").agg(F.sort_array(F.collect_list(F.struct("place", "relative"))).alias("found"))
    joined = parsed.select("local_path", "pieces", "rest").join(found, "local_path", "left")
    local = F.coalesce(F.transform("found", lambda x: x.relative), F.array().cast("array<string>"))
    return joined.select("local_path", let(local, lambda paths: put_together(F.col("pieces"), F.col("rest"), paths)).alias("text"))
