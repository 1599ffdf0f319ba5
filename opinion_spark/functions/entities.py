"""HTML character references as characters, with Spark's own functions.

What the standard library makes of a text is the rule: its table of names is the literal map here, and
its exceptions among the small numbers are asked from it.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow an ampersand: a number, or up to 32 characters that may be a name.
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{1,32};?)"
#: Names that count without a semicolon, also at the start of a longer word, the longest first.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Small numbers that do not stand for their own character.
SMALL = {n: html.unescape(f"&#{n};") for n in range(0xA0) if html.unescape(f"&#{n};") != chr(n)}
LAST, REPLACEMENT = 0x10FFFF, "�"


def _map(values: dict) -> Column:
    """A literal map of strings, written as one string so that the plan stays short."""
    pairs = "\x02".join(f"{key}\x01{value}" for key, value in values.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))


def _behind(text: Column, start: Column) -> Column:
    return F.substring(text, F.length(start) + 1, F.length(text))


def _number(reference: Column) -> Column:
    digits = F.regexp_replace(reference, r"^#[xX]?0*|;$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    is_hex = F.lower(F.substring(reference, 2, 1)) == "x"
    value = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    value = F.when(F.length(digits) > 8, F.lit(LAST + 1)).otherwise(value)
    outside = value.between(0xD800, 0xDFFF) | (value > LAST)
    nothing = value.between(0xFDD0, 0xFDEF) | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    character = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    return (
        F.when(outside, F.lit(REPLACEMENT))
        .when(value < 0xA0, F.coalesce(_map(SMALL)[value.cast("string")], character))
        .when(nothing, F.lit(""))
        .otherwise(character)
    )


def _name(reference: Column) -> Column:
    names = _map(html5)
    start = F.regexp_extract(reference, "^(?:" + "|".join(OPEN_NAMES) + ")", 0)
    started = F.when(start != "", F.concat(names[start], _behind(reference, start)))
    return F.coalesce(names[reference], started, F.concat(F.lit("&"), reference))


def _decoded(part: Column) -> Column:
    """What follows an ampersand, with the reference it starts with as characters."""
    reference = F.regexp_extract(part, REFERENCE, 0)
    meant = F.when(F.startswith(reference, F.lit("#")), _number(reference)).otherwise(_name(reference))
    return F.when(reference == "", F.concat(F.lit("&"), part)).otherwise(F.concat(meant, _behind(part, reference)))


def unescaped(text: Column) -> Column:
    """``text`` with all references of the standard as characters; null stays null."""
    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), _decoded)
    whole = F.concat(parts[0], F.array_join(rest, ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
