"""What the topics share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(c: Column | str) -> Column:
    """Rounded to 4 digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)
