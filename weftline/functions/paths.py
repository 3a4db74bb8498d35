"""Where a URL's content lies on disk, and how one local file refers to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .common import let, one_of

# Suffixes that are no pages, and suffixes of pages.
NON_PAGE_SUFFIXES = (
    ".css", ".js", ".mjs", ".json", ".xml", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".avif", ".woff", ".woff2",
    ".ttf", ".otf", ".eot", ".mp4", ".webm", ".mp3", ".ogg", ".wav", ".pdf", ".zip", ".gz", ".tar", ".br", ".map", ".csv", ".wasm",
    ".bmp", ".tiff",
)
PAGE_SUFFIXES = (".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".cgi", ".shtml", ".xhtml")
RESERVED_NAMES = (
    "con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)

_UNSAFE = r'[<>:"|?*\x00-\x1f]'


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, _UNSAFE, "_")


def query_mark(query: Column) -> Column:
    """_q and ten hex digits of the query's SHA-256; empty without a query."""
    return F.when(query != "", F.concat(F.lit("_q"), F.substring(F.sha2(query, 256), 1, 10))).otherwise("")


def relative_file(url: Column) -> Column:
    """The file within its zone: unsafe characters replaced, index.html for paths without a suffix, the query as a mark."""
    def named(p):
        mark = query_mark(U.query(url))
        index = F.concat(F.lit("index"), mark, F.lit(".html"))
        parts = F.split(p, "/", -1)

        def file(parts):
            tail = F.try_element_at(parts, F.lit(-1))
            folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), safe_name)
            with_suffix = F.concat(
                safe_name(F.regexp_extract(tail, r"(?s)^(.*)\.[^.]*$", 1)), mark, F.lit("."), F.regexp_extract(tail, r"(?s)\.([^.]*)$", 1))
            whole = F.when(F.contains(tail, F.lit(".")), F.concat(folders, F.array(with_suffix))).otherwise(F.concat(F.transform(parts, safe_name), F.array(index)))
            # A path of parts drops those that are a dot.
            return F.array_join(F.filter(whole, lambda x: ~x.isin("", ".")), "/")

        return F.when(p == "", index).otherwise(let(parts, file))

    return let(F.regexp_replace(F.regexp_replace(U.path(url), "/{2,}", "/"), "^/+|/+$", ""), named)


def file_by_host(url: Column, base_host: Column) -> Column:
    """pages/ for the base host (with port), external/<host>/ for others."""
    authority = F.lower(F.coalesce(F.nullif(U.netloc(url), F.lit("")), F.lit("unknown")))
    host = F.coalesce(F.nullif(U.hostname(url), F.lit("")), authority)
    return F.concat(F.when(authority == F.lower(base_host), F.lit("pages/")).otherwise(F.concat(F.lit("external/"), host, F.lit("/"))), relative_file(url))


def is_page(url: Column) -> Column:
    """By suffix; an unknown one is no page."""
    found = U.suffix(U.path(url))
    return (found == "") | one_of(found, PAGE_SUFFIXES)


def is_root(url: Column, start: Column) -> Column:
    """The start host's empty path or the start path; the query does not matter."""
    bare = F.regexp_replace(U.path(url), "/+$", "")
    return (U.netloc(url) == U.netloc(start)) & ((bare == "") | (bare == F.regexp_replace(U.path(start), "/+$", "")))


def save_path(url: Column, start: Column) -> Column:
    """index.html, pages/, assets/ or external/<host>/, relative to the project."""
    local = (F.lower(U.netloc(url)) == F.lower(U.netloc(start))) | (U.netloc(url) == "")
    host = F.coalesce(F.nullif(U.hostname(url), F.lit("")), U.netloc(url))
    return (
        F.when(local & is_page(url) & is_root(url, start), F.lit("index.html"))
        .when(local & is_page(url), F.concat(F.lit("pages/"), relative_file(url)))
        .when(local, F.concat(F.lit("assets/"), relative_file(url)))
        .otherwise(F.concat(F.lit("external/"), host, F.lit("/"), relative_file(url))))


def zone(saved: Column) -> Column:
    """The first folder of a saved path; index.html has its own."""
    return F.substring_index(saved, "/", 1)


def relative_path(from_file: Column, to_file: Column) -> Column:
    """The POSIX path from one file's folder to another file; `.` where nothing is left."""
    def hops(parts):
        here, there = parts.here, parts.there
        shared = F.aggregate(
            F.sequence(F.lit(0), F.greatest(F.size(here), F.lit(1)) - 1), F.lit(0),
            lambda n, i: F.when((n == i) & (F.get(here, i) == F.get(there, i)), n + 1).otherwise(n))
        return let(shared, lambda n: F.concat(F.array_repeat(F.lit(".."), F.size(here) - n), F.slice(there, n + 1, F.greatest(F.size(there) - n, F.lit(0)))))

    folder = F.filter(F.split(F.regexp_replace(from_file, "[^/]*$", ""), "/", -1), lambda x: x != "")
    target = F.filter(F.split(to_file, "/", -1), lambda x: x != "")
    joined = let(F.struct(folder.alias("here"), target.alias("there")), hops)
    return let(F.array_join(joined, "/"), lambda p: F.when(p == "", ".").otherwise(p))


def project_name(name: Column, fallback: str = "weftline_project") -> Column:
    """A folder name that every file system accepts; the fallback where nothing of it is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")
    return let(F.coalesce(cleaned, F.lit("")), lambda c: F.when(F.replace(c, F.lit("_"), F.lit("")) == "", F.lit(fallback)).when(
        one_of(F.lower(c), RESERVED_NAMES), F.concat(c, F.lit("_"))).otherwise(c))


def is_rewritable(saved: Column) -> Column:
    """Pages by their suffix, and stylesheets."""
    return one_of(U.suffix(saved), (*PAGE_SUFFIXES, ".css"))
