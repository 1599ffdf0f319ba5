"""Evaluate a costly column once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """``value`` as the output of a generator, one row for one row.

    A filter on a plain column moves below the projection and takes a copy of the expression with
    it, so JSON, CSV or HTML would be read again for each use.
    """
    return F.explode(F.array(value))
