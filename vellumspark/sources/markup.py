"""Text of markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities of running text; the ampersand is last, so that nothing is unescaped twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def text_of(html: Column) -> Column:
    """Scripts and styles dropped, tags to blanks, entities unescaped, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")), r"\s+", " "))
