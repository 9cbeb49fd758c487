"""Levels above a point of the plane, and the outlines' lines that they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_levels(columns: DataFrame, tolerance: float) -> DataFrame:
    """``levels`` (an array of heights) sorted, and neighbours nearer than the tolerance made one.

    The lowest and the highest keep their heights, others meet in the middle, and two levels that are all there is stay
    two. A merged level is compared with the next, so this is a fold.
    """
    top = "k = size(z) - 1"
    joined = f"CASE WHEN size(s.done) = 0 THEN s.cur WHEN {top} THEN z[k] ELSE 0.5D * (s.cur + z[k]) END"
    near = f"abs(s.cur - z[k]) < {tolerance}D AND NOT (size(s.done) = 0 AND {top})"
    step = f"CASE WHEN {near} THEN named_struct('done', s.done, 'cur', {joined}) ELSE named_struct('done', concat(s.done, array(s.cur)), 'cur', z[k]) END"
    fold = f"aggregate(sequence(1, size(z) - 1), named_struct('done', CAST(array() AS array<double>), 'cur', z[0]), (s, k) -> {step}, s -> concat(s.done, array(s.cur)))"
    rows = columns.withColumn("z", F.array_sort(F.expr("transform(levels, v -> CAST(v AS DOUBLE))")))
    return rows.withColumn("levels", F.expr(f"CASE WHEN size(z) > 1 THEN {fold} ELSE z END")).drop("z")


def divide_levels(columns: DataFrame, seed: str) -> DataFrame:
    """Further levels between neighbours, as many as bring their distance nearest to ``seed`` (a column or a number)."""
    parts = "CAST(floor((levels[i + 1] - levels[i]) / ({seed}) + 0.5D - 1e-15D) AS INT)".replace("{seed}", seed)
    inner = f"transform(sequence(0, greatest({parts}, 1) - 1), j -> levels[i] + j * ((levels[i + 1] - levels[i]) / greatest({parts}, 1)))"
    made = f"concat(flatten(transform(sequence(0, size(levels) - 2), i -> {inner})), array(levels[size(levels) - 1]))"
    return columns.withColumn("levels", F.expr(f"CASE WHEN size(levels) > 1 THEN {made} ELSE levels END"))


def open_ends(lines: DataFrame) -> DataFrame:
    """Nodes (node_id) at which only one of the lines (elem_id, nodes) ends; none if the outlines are closed."""
    ends = lines.select("elem_id", F.explode("nodes").alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("n")).where("n = 1").select("node_id")
