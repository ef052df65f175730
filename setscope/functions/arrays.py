"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_text(col: str | Column) -> Column:
    """Array as text ``[a, b]`` (F4), the form stored in every result."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string")
