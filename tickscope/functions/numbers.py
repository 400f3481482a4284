"""Rounding that does not depend on how a sum was split over tasks."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_round(x, digits: int) -> Column:
    """Half-up rounding after the noise of floating-point summation is cut off far below the last digit."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(F.round(c, 9), digits)
