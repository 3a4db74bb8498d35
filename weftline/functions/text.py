"""Encodings, declarations of them, srcset lists and asset kinds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import let, one_of

# Names of Shift-JIS (without marks), suffixes by kind, the bytes that are searched for a declaration, and the
# pattern of one, whose group is the name.
SHIFT_JIS_NAMES = ("shiftjis", "shift-jis", "sjis", "xsjis", "mskanji", "csshiftjis", "shiftjis2004", "shiftjisx0213")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".ico")
FONT_SUFFIXES = (".woff", ".woff2", ".ttf", ".otf", ".eot")
HEAD_BYTES = 4096
CHARSET_PATTERN = r"""(?i)charset\s*=\s*['"]?([A-Za-z0-9_\-.:]+)"""


def charset_of_header(content_type: Column) -> Column:
    """The first unquoted name; a quoted one counts as none."""
    words = F.split(F.regexp_replace(content_type, r"\s*=\s*", "="), r"[\s;,]+", -1)
    named = F.filter(words, lambda w: F.startswith(F.lower(w), F.lit("charset=")))
    return F.nullif(F.substring_index(F.substring_index(F.substring(F.get(named, 0), 9, 1 << 30), '"', 1), "'", 1), F.lit(""))


def charset_of_bytes(body: Column, most: int = HEAD_BYTES) -> Column:
    """The first declaration within the first bytes."""
    head = F.decode(F.substring(body, 1, most), "ISO-8859-1")
    return F.nullif(F.regexp_extract(head, CHARSET_PATTERN, 1), F.lit(""))


def encoding_name(name: Column) -> Column:
    """cp932 for all names of Shift-JIS; others unchanged."""
    return F.when(one_of(F.lower(F.translate(name, "-_ ", "")), SHIFT_JIS_NAMES), F.lit("cp932")).otherwise(name)


def utf8(body: Column) -> Column:
    """The text of a valid UTF-8 body, else null."""
    return F.try_validate_utf8(body.cast("string"))


@F.arrow_udf(StringType())
def _decoded(bodies: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    def one(body, *names):
        if body is None:
            return None
        for name in names:
            if name:
                try:
                    return body.decode(name)
                except (LookupError, UnicodeDecodeError):
                    pass
        return body.decode("utf-8", "replace")

    return pa.array([one(*x) for x in zip(bodies.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)], pa.string())


def decode_body(body: Column, content_type: Column) -> Column:
    """The text of a page: by its header, else by its own declaration, else as UTF-8 with replacements.

    UTF-8 is decoded by the JVM; only other encodings go to an Arrow function, which the JVM has no tables for.
    """
    header, inner = encoding_name(charset_of_header(content_type)), encoding_name(charset_of_bytes(body))
    plain = F.lower(F.translate(F.coalesce(header, inner, F.lit("utf8")), "-_ ", "")) == "utf8"
    foreign = F.when(~(plain & utf8(body).isNotNull()), body)  # null rows cost the function nothing
    return F.coalesce(F.when(plain, utf8(body)), _decoded(foreign, header, inner))


_META_TAG = r"(?i)<meta\b[^>]*>"
_DECLARED = r"""(?i)(?<![\w-])(charset\s*=\s*["']?)[^\s"'/>;]+"""
_OF_CONTENT_TYPE = r"""(?i)\shttp-equiv\s*=\s*["']?content-type["'\s/>][^>]*?\bcontent\s*="""


def _declaring(tag: Column) -> Column:
    """A meta element with its charset as UTF-8; one that says that it stands for the content type, and after that has
    a content without a charset, gets it."""
    renamed = F.regexp_replace(tag, _DECLARED, "$1UTF-8")
    filled = F.regexp_replace(renamed, r"""(?i)(\scontent\s*=\s*)(["'])\s*\2""", "$1$2 charset=UTF-8$2")
    longer = F.regexp_replace(renamed, r"""(?i)(\scontent\s*=\s*)(["'])([^"']*?)[\s;]*\2""", "$1$2$3; charset=UTF-8$2")
    lacks = F.rlike(renamed, F.lit(_OF_CONTENT_TYPE)) & ~F.contains(F.lower(renamed), F.lit("charset"))
    return F.when(~lacks, renamed).when(filled != renamed, filled).otherwise(longer)


def declare_utf8(html: Column) -> Column:
    """Every charset that a meta element declares becomes UTF-8; a content-type declaration without one gets it; others
    are untouched. The page is parted at its meta elements and put together again around the new ones."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(_META_TAG), F.lit(0)), _declaring)
    joined = F.zip_with(F.split(html, _META_TAG, -1), tags, lambda text, tag: F.concat(text, F.coalesce(tag, F.lit(""))))
    return F.when(F.rlike(html, F.lit(_META_TAG)), F.array_join(joined, "")).otherwise(html)


def srcset_urls(srcset: Column) -> Column:
    """The first token of each entry; entries are cut at every comma."""
    entries = F.transform(F.split(srcset, ",", -1), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
    return F.filter(entries, lambda x: x != "")


def guess_kind(url: Column, context: str = "general") -> Column:
    """Of a stylesheet's reference: by where it stands, else by the end of the address, its query included."""
    if context in ("import", "font-face"):
        return F.lit({"import": "stylesheet", "font-face": "font"}[context])
    ends = lambda names: F.rlike(F.lower(url), F.lit("(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")$"))
    return F.when(ends(IMAGE_SUFFIXES), "image").when(ends(FONT_SUFFIXES), "font").otherwise("other")


def wanted_kind(kind: Column, policy: str) -> Column:
    """Whether an asset's kind is fetched: all, none, images or css_js; any other policy is all."""
    if policy == "none":
        return F.lit(False)
    if policy == "images":
        return kind.isin("image", "icon")
    if policy == "css_js":
        return kind.isin("stylesheet", "script")
    return F.lit(True)


def lines(text: Column) -> Column:
    """The trimmed, non-blank lines."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def page_title(html: Column) -> Column:
    """The first title, trimmed, with the common entities and decimal references read; null where it is empty.

    Titles that hold other entities are read by the extractor.
    """
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>([^<]*)</title\s*>", 1)
    text = raw
    for name, char in _NAMED.items():
        if name != "amp":
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    for code in (39, 34):
        text = F.replace(text, F.lit(f"&#{code};"), F.lit(chr(code)))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def progress_percent(done: Column, total: Column) -> Column:
    """Whole per cent; null where the total is zero."""
    return F.floor(F.try_divide(done, total) * 100).cast("int")
