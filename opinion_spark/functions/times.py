"""Column functions for post times, all on epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def created_ms(created_at: Column) -> Column:
    """Epoch ms of ``Sat Jul 27 00:00:00 +0000 2013``; the weekday is not parsed."""
    stamp = F.substring(created_at, 5, 64)
    return F.unix_millis(F.try_to_timestamp(stamp, F.lit("MMM dd HH:mm:ss Z yyyy")))


def readable(ms: Column, tz: str = "UTC", label: str | None = None) -> Column:
    """``Sat Jul 27 00:00:00 JST 2013`` in ``tz``, whatever the session time zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    zone = (label or tz).replace("'", "''")
    return F.date_format(local, f"EEE MMM dd HH:mm:ss '{zone}' yyyy")


def day_bucket(ms: Column, anchor_ms: int, days: int) -> Column:
    """Start of the day, counted back from ``anchor_ms``; 0 outside the ``days`` days."""
    day = F.floor((ms - F.lit(anchor_ms)) / F.lit(DAY_MS))
    inside = day.between(1 - days, 0)
    return F.when(inside, F.lit(anchor_ms) + day * DAY_MS).otherwise(F.lit(0)).cast("bigint")
