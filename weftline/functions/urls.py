"""URL algebra as Column expressions: split, resolve, normalise, compare, strip, classify.

Everything stays on the JVM. parse_url and its kin are not used: they reject addresses that occur on real pages.
A null address gives null, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, one_of

# What counts as an asset by its suffix, schemes that are no pages, tracking parameters.
ASSET_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".avif", ".css", ".js", ".mjs",
    ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp4", ".webm", ".ogg", ".mp3", ".wav", ".flac",
    ".pdf", ".zip", ".tar", ".gz", ".exe", ".dmg", ".iso", ".json", ".xml", ".csv", ".wasm",
)
EXCLUDED_SCHEMES = ("mailto", "tel", "javascript", "data", "blob", "ftp")
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "data")
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid")

#: RFC 3986, appendix B.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_EDGE = r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$"


def _group(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def scheme(url: Column) -> Column:
    """In lower case; empty where there is none."""
    return F.lower(_group(url, 1))


def netloc(url: Column) -> Column:
    return _group(url, 2)


def path(url: Column) -> Column:
    """Without the ;parameters of the last segment."""
    return F.regexp_replace(_group(url, 3), r"(?s);[^/]*$", "")


def query(url: Column) -> Column:
    return _group(url, 4)


def fragment(url: Column) -> Column:
    return _group(url, 5)


def hostname(url: Column) -> Column:
    """In lower case, without user and port; brackets of IPv6 stay; empty where there is none."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def _port(authority: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    # After a host a path begins with a slash, also where too many `..` have taken it away.
    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise("")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), rooted, path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def _folded(segments: Column, rooted: Column) -> Column:
    """Segments without `.`, and with `..` taking away the one before it; a `..` too many stays only in unrooted paths."""
    def step(done, segment):
        takes = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(segment == ".", done)
            .when((segment == "..") & takes, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((segment == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(segment))))

    return F.aggregate(segments, F.array().cast("array<string>"), step)


def _merged(base_path: Column, relative: Column) -> Column:
    """The path of a relative reference against that of its base, dot segments resolved."""
    directory = let(F.split(base_path, "/", -1), lambda p: F.when(F.try_element_at(p, F.lit(-1)) != "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    joined = let(F.concat(directory, F.split(relative, "/", -1)), lambda s: F.filter(s, lambda x, i: (i == 0) | (i == F.size(s) - 1) | (x != "")))
    segments = F.when(relative.startswith("/"), F.split(relative, "/", -1)).otherwise(joined)

    def finish(s):
        ended = F.try_element_at(s, F.lit(-1)).isin(".", "..")
        # The fold sees the leading empty segment as any other, so a surplus `..` takes it.
        folded = _folded(s, F.lit(True))
        return F.array_join(F.when(ended, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")

    return let(let(segments, finish), lambda p: F.when(p == "", "/").otherwise(p))


def resolve(url: Column, base: Column) -> Column:
    """The reference against its base: absolute ones stay, the fragment is kept, nothing else is normalised."""
    same = (_group(url, 1) == "") | (scheme(url) == scheme(base))
    local = F.when(netloc(url) != "", unsplit(scheme(base), netloc(url), _group(url, 3), query(url), fragment(url))).when(
        _group(url, 3) == "",
        unsplit(scheme(base), netloc(base), _group(base, 3), F.when(query(url) != "", query(url)).otherwise(query(base)), fragment(url)),
    ).otherwise(unsplit(scheme(base), netloc(base), _merged(_group(base, 3), _group(url, 3)), query(url), fragment(url)))
    hierarchical = scheme(base).isin("http", "https", "ftp", "file", "")
    return F.when(F.coalesce(base, F.lit("")) == "", url).when(url == "", base).when(same & hierarchical, local).otherwise(url)


def _pairs(query: Column) -> Column:
    """Decoded (k, v) of a query, blank values kept."""
    def plain(text):
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))

    items = F.filter(F.split(query, "&", -1), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(
        plain(F.substring_index(x, "=", 1)).alias("k"),
        F.when(F.contains(x, F.lit("=")), plain(F.regexp_replace(x, r"(?s)^[^=]*=", ""))).otherwise("").alias("v")))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sorted_query(query: Column, without=()) -> Column:
    """The query form-encoded anew, by key, then value; names in `without` (any case) left out."""
    pairs = _pairs(query)
    if without:
        pairs = F.filter(pairs, lambda p: ~one_of(F.lower(p.k), [w.lower() for w in without]))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p.k), F.lit("="), _encoded(p.v))), "&")


def clean_path(path: Column) -> Column:
    """Runs of `/` collapsed, dot segments resolved, a leading `/` ensured, and a trailing one kept."""
    def rebuilt(p):
        segments = F.filter(F.split(p, "/", -1), lambda x: x != "")
        body = F.concat(F.lit("/"), F.array_join(_folded(segments, p.startswith("/")), "/"))
        return F.when(p.endswith("/") & (F.length(p) > 1) & ~body.endswith("/"), F.concat(body, F.lit("/"))).otherwise(body)

    return let(F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/"), rebuilt)


def normalise(url: Column, base: Column | None = None) -> Column:
    """The canonical form: resolved, scheme and host in lower case, default port, user, parameters and fragment dropped,
    path cleaned, query sorted. Blank and null give an empty text; excluded schemes stay as they are; a port that is no
    number up to 65535 gives null. Brackets of IPv6 hosts are kept.
    """
    trimmed = F.regexp_replace(F.coalesce(url, F.lit("")), _EDGE, "")
    default = F.lit("https") if base is None else F.coalesce(F.nullif(scheme(base), F.lit("")), F.lit("https"))

    def joined(u):
        absolute = F.when(u.startswith("//"), F.concat(default, F.lit(":"), u)).otherwise(u)
        return absolute if base is None else let(absolute, lambda a: resolve(a, base))

    def canonical(u):
        kind = F.coalesce(F.nullif(scheme(u), F.lit("")), F.lit("https"))
        port = _port(netloc(u))
        number = port.try_cast("int")
        good = (port == "") | number.between(0, 65535)
        usual = ((kind == "http") & (number == 80)) | ((kind == "https") & (number == 443))
        authority = F.concat(hostname(u), F.when((port != "") & ~usual, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))
        whole = F.concat(kind, F.lit("://"), authority, clean_path(path(u)), F.when(query(u) != "", let(sorted_query(query(u)), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise(""))
        return F.when(one_of(scheme(u), EXCLUDED_SCHEMES), u).when(F.coalesce(good, F.lit(False)), whole)

    return let(trimmed, lambda t: F.when(t == "", F.lit("")).otherwise(let(joined(t), canonical)))


def strip_tracking(url: Column, names=TRACKING_PARAMS) -> Column:
    """Without the named parameters (any case). Unchanged where there is no query or no names; else sorted and encoded."""
    if not names:
        return url
    stripped = unsplit(scheme(url), netloc(url), _group(url, 3), sorted_query(query(url), names), fragment(url))
    return F.when(query(url) == "", url).otherwise(stripped)


def is_same_host(a: Column, b: Column) -> Column:
    """Ports do not matter; two addresses without a host are equal."""
    return F.coalesce(hostname(a), F.lit("")) == F.coalesce(hostname(b), F.lit(""))


def is_subdomain(url: Column, reference: Column) -> Column:
    h, r = F.coalesce(hostname(url), F.lit("")), F.coalesce(hostname(reference), F.lit(""))
    return (h != "") & (r != "") & (h != r) & F.endswith(h, F.concat(F.lit("."), r))


def suffix(path: Column) -> Column:
    """The last suffix of the last segment in lower case, trailing slashes aside; empty for dot files."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"[^/](\.[^./]+)$", 1))


def is_asset(url: Column) -> Column:
    return F.endswith(F.lower(path(url)), F.lit(".tar.gz")) | one_of(suffix(path(url)), ASSET_SUFFIXES)


def is_excluded_scheme(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"(?i)^\s*(?:" + "|".join(EXCLUDED_SCHEMES) + "):")), F.lit(False))


def is_skipped(url: Column) -> Column:
    """References that name nothing to fetch: blank, a bare fragment, or one of four schemes."""
    trimmed = F.regexp_replace(F.coalesce(url, F.lit("")), _EDGE, "")
    return (trimmed == "") | trimmed.startswith("#") | one_of(scheme(trimmed), SKIPPED_SCHEMES)


def reference(url: Column, base: Column) -> Column:
    """The resolved reference, or null where it is skipped."""
    return F.when(~is_skipped(url), resolve(F.regexp_replace(url, _EDGE, ""), base))


def should_crawl(url: Column, start: Column, subdomains: bool = False) -> Column:
    near = is_same_host(url, start)
    if subdomains:
        near = near | is_subdomain(url, start)
    return scheme(url).isin("http", "https", "") & near & ~is_asset(url)


def is_excluded_path(url: Column, patterns) -> Column:
    """Any pattern is a part of the whole address."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(url, F.lit(p))
    return found


def has_excluded_extension(url: Column, extensions) -> Column:
    found = F.lit(False)
    for e in extensions:
        found = found | F.endswith(F.lower(path(url)), F.lit(e.lower()))
    return found


def robots_url(url: Column) -> Column:
    return F.when(netloc(url) != "", F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/robots.txt")))


def is_start_url(text: Column) -> Column:
    """What a crawl accepts as its start: http or https, in lower case."""
    return F.coalesce(text.startswith("http://") | text.startswith("https://"), F.lit(False))
