"""HTML and URL functions as column expressions.

The patterns of titles, comments, scripts, tags and links are fixed values: they say
what counts as text and as a link.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOST = "https://docs.test"
DISALLOWED = ("/admin/",)
#: Entities that are replaced without leaving the JVM; others need the full table.
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—"}


def folded(text: Column) -> Column:
    """Runs of white space (Unicode's) as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Character references of the full HTML table, in one pass.

    Texts whose references are all common ones are handled by replacements,
    the ampersand's own last; only others go through Python.
    """
    common = text
    for entity, character in COMMON_ENTITIES.items():
        common = F.replace(common, F.lit(entity), F.lit(character))
    common = F.replace(common, F.lit("&amp;"), F.lit("&"))
    known = "|".join(e[1:] for e in ["&amp;", *COMMON_ENTITIES])
    odd = text.rlike(f"&(?!(?:{known}))[#a-zA-Z]") | text.rlike("&amp;(?:[#a-zA-Z])")
    return F.when(odd, _unescape(F.when(odd, text))).otherwise(common)


def title_of(page: Column) -> Column:
    """Text of the first <title>; empty if there is none."""
    inner = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return folded(unescaped(F.regexp_replace(inner, "<[^>]+>", "")))


def text_of(page: Column) -> Column:
    """Visible text, the title's included: no comments, scripts, styles, tags."""
    text = F.regexp_replace(F.coalesce(page, F.lit("")), "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return folded(unescaped(F.regexp_replace(text, "<[^>]+>", " ")))


def hrefs_of(page: Column) -> Column:
    """Quoted href values of <a> tags in the raw page, in order."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def path_of(url: Column) -> Column:
    """The path of a URL; / if there is none. URLs with characters that Java's parser rejects have one too."""
    loose = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.nullif(loose, F.lit("")), F.lit("/"))


def is_allowed(url: Column, disallowed: tuple[str, ...] = DISALLOWED) -> Column:
    """Whether the URL's path starts with none of the prefixes."""
    allowed = F.lit(True)
    for prefix in disallowed:
        allowed = allowed & ~path_of(url).startswith(prefix)
    return allowed


def topic_of(url: Column) -> Column:
    """The first segment of the URL's path, or empty."""
    return F.split_part(F.regexp_replace(path_of(url), "^/+", ""), F.lit("/"), F.lit(1))


def resolved(href: Column, host: str = HOST) -> Column:
    """A page id (letter, at least four digits) for an id or for a URL on the host; else null."""

    def id_of(x: Column) -> Column:
        letter, digits = F.regexp_extract(x, "^([a-zA-Z])([0-9]+)$", 1), F.regexp_extract(x, "^([a-zA-Z])([0-9]+)$", 2)
        return F.when(letter != "", F.concat(F.lower(letter), F.format_string("%04d", digits.cast("long"))))

    h = F.regexp_replace(href, r"(?U)^\s+|\s+$", "")
    last = F.element_at(F.split(F.regexp_replace(path_of(h), "/+$", ""), "/"), -1)
    return F.coalesce(id_of(h), F.when(h.startswith(host), id_of(last)))


def outlinks_of(page: Column, host: str = HOST) -> Column:
    """Resolved page ids that the page links to, each at its first place."""
    return F.array_distinct(F.filter(F.transform(hrefs_of(page), lambda h: resolved(h, host)), lambda x: x.isNotNull()))


def page_number(page_id: Column) -> Column:
    """p0001 as 1; anything else but p and digits is an error."""
    digits = F.regexp_extract(page_id, "^p([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad page id: "), F.coalesce(page_id, F.lit("null")))).cast("long"))


def page_name(number: Column) -> Column:
    """1 as p0001; larger numbers widen."""
    return F.format_string("p%04d", number)
