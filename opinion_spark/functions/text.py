"""Column functions for post texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinion_spark.functions.entities import unescaped


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when ``text`` holds at least one of ``terms`` (case-sensitive, literal)."""
    hits = [F.contains(text, F.lit(t)) for t in dict.fromkeys(terms)]
    return F.coalesce(reduce(or_, hits), F.lit(False)) if hits else F.lit(False)


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes in hex."""
    return F.sha2(text.cast("binary"), 256)


def to_base64(text: Column) -> Column:
    """Base64 of the UTF-8 bytes on one line, whatever the session says about chunking."""
    return F.translate(F.base64(text.cast("binary")), "\r\n", "")


def from_base64(encoded: Column) -> Column:
    """Text of a base64 key, NULL when it cannot be decoded."""
    return F.try_to_binary(encoded, F.lit("base64")).cast("string")


def one_line(text: Column) -> Column:
    """White space runs become one blank and commas full-width, so the text fits a CSV key."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), ",", "，")


def strict_long(token: Column) -> Column:
    """Whole-token integer parse; NULL for anything else, padded tokens included."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("bigint"))


def html_title(html: Column) -> Column:
    """Text of the first title element, NULL when the page has none."""
    title = F.regexp_substr(html, F.lit(r"(?is)<title[^>]*>.*?</title>"))
    title = F.regexp_replace(title, r"(?is)^<title[^>]*>|</title>$", "")
    # a no-break space counts as white space, as a blank does
    return F.trim(F.regexp_replace(unescaped(title), r"[\s\x{A0}]+", " "))
