"""A value that an expression uses often, computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value): what is built from the value doesn't repeat its expression, so a document is parsed once, not for each field."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
