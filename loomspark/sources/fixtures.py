"""Small models that queries, tests and the benchmark share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def yarn_grid(spark: SparkSession, side: int = 4, n_nodes: int = 16, half: float = 0.035) -> DataFrame:
    """side * side straight yarns along x with square sections; y counts slowest."""
    step = f"(0.7D / {max(1, side - 1)})"
    node = f"""transform(sequence(0, {n_nodes - 1}), i -> named_struct('x', i / {float(n_nodes - 1)}D, 'y', 0.15D + (id div {side}) * {step}, 'z', 0.15D + (id % {side}) * {step},
        'tx', 1D, 'ty', 0D, 'tz', 0D, 'ux', 0D, 'uy', 0D, 'uz', 1D, 'sx', 0D, 'sy', -1D, 'sz', 0D))"""
    ring = ", ".join(f"named_struct('x', {a * half!r}D, 'y', {b * half!r}D)" for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)))
    return spark.range(side * side).select(F.col("id").cast("int").alias("yarn_id"), F.expr(node).alias("nodes"), F.expr(f"array({ring})").alias("section"), F.expr("array(named_struct('x', 0D, 'y', 0D, 'z', 0D))").alias("translations"))


def square_yarn(spark: SparkSession, half: float = 0.24) -> DataFrame:
    """One yarn along x through the middle of the unit cube."""
    node = "transform(sequence(0, 1), i -> named_struct('x', CAST(i AS DOUBLE), 'y', 0.5D, 'z', 0.5D, 'tx', 1D, 'ty', 0D, 'tz', 0D, 'ux', 0D, 'uy', 0D, 'uz', 1D, 'sx', 0D, 'sy', -1D, 'sz', 0D))"
    ring = ", ".join(f"named_struct('x', {a * half!r}D, 'y', {b * half!r}D)" for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)))
    return spark.range(1).select(F.lit(0).alias("yarn_id"), F.expr(node).alias("nodes"), F.expr(f"array({ring})").alias("section"), F.expr("array(named_struct('x', 0D, 'y', 0D, 'z', 0D))").alias("translations"))
