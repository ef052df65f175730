"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_text(col: str | Column, length: int) -> Column:
    """Whole text cut into consecutive pieces of ``length`` characters.

    Returns array<string>; the last piece may be shorter, an empty or NULL
    text gives no piece. Every character of the text is kept.
    """
    c = F.col(col) if isinstance(col, str) else col
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(length))
    return F.when(F.length(c) > 0,
                  F.transform(starts, lambda s: F.substring(c, s, length))
                  ).otherwise(F.array().cast("array<string>"))
