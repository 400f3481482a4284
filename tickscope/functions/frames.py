"""One-row results inside other queries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """A frame of at most one row as a struct: a scalar subquery, null if there is no row, an error if there are two."""
    return df.select(F.struct("*").alias("row")).scalar()
