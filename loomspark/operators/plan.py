"""Help for the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    Catalyst moves filters below a projection and puts the expressions in place of its names, so a costly one
    that a filter uses often is computed as often. A generator of one row isn't seen through.
    """
    held = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_held"))
    return held.select(*df.columns, *(F.col(f"_held.{n}").alias(n) for n in columns))
