"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later expressions refer to rather than repeat: a generator of one row is between them.

    They are computed in a projection below it, which Spark compiles, as it doesn't a generator's own expressions.
    """
    return rows.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_fixed")).select("*", F.inline(F.array("_fixed"))).drop("_fixed")
