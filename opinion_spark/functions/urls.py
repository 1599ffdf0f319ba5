"""Column functions for URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocols that a URL may name, and what a usable port looks like.
KNOWN_PROTOCOL = r"(?i)^\s*(url:)?(https?|ftp|file|jar|mailto):"
BAD_PORT = r"^\s*[A-Za-z]+://[^/?#]*:[^/?#\]]*[^0-9/?#\]][^/?#\]]*([/?#]|$)"

# A parameter whose value is all digits.
NUMERIC_PARAMETER = r"(^|&)[^=&]*=[0-9]+(=|&|$)"


def is_malformed(url: Column) -> Column:
    """True for a string that names no known protocol or no usable port."""
    userinfo_free = F.regexp_replace(url, r"^(\s*[A-Za-z]+://)[^/?#]*@", "$1")
    return ~url.rlike(KNOWN_PROTOCOL) | userinfo_free.rlike(BAD_PORT)


def trim_url(url: Column) -> Column:
    """Drop the fragment, and the query unless a parameter has an all-digit value."""
    body = F.regexp_replace(url, r"(?s)#.*$", "")
    query = F.regexp_extract(body, r"(?s)\?(.*)$", 1)
    return (
        F.when(is_malformed(url), url)
        .when(query.rlike(NUMERIC_PARAMETER), body)
        .otherwise(F.regexp_replace(body, r"(?s)\?.*$", ""))
    )
