"""Vertical rays through triangle meshes: what stands above and below each place of a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells along each side of the rays' extent.
CELLS = 32


def vertical_hits(columns: DataFrame, triangles: DataFrame, extent=((0.0, 0.0), (1.0, 1.0)), steep: float = 1e-9) -> DataFrame:
    """(column_id, tri_id, mesh_id, z): where the vertical line at each (x, y) passes through a triangle
    (tri_id, mesh_id, x0, y0, z0 ... z2). Triangles that stand (nearly) upright have no such place.

    Both sides meet in the cells of a lattice: a triangle under every cell its box touches, a line under its own.
    """
    (x0, y0), (x1, y1) = extent
    cell = lambda e, lo, hi: f"CAST(least({CELLS - 1}, greatest(0, floor(({e} - {lo!r}D) * {CELLS / max(hi - lo, 1e-12)!r}D))) AS INT)"
    stand = columns.withColumn("cell", F.expr(f"{cell('x', x0, x1)} * {CELLS} + {cell('y', y0, y1)}"))
    span = lambda c, lo, hi: f"sequence({cell(f'least({c}0, {c}1, {c}2)', lo, hi)}, {cell(f'greatest({c}0, {c}1, {c}2)', lo, hi)})"
    flat = "((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))"
    listed = triangles.where(f"abs({flat}) > {steep!r}D").withColumn("cell", F.explode(F.expr(f"flatten(transform({span('x', x0, x1)}, i -> transform({span('y', y0, y1)}, j -> i * {CELLS} + j)))")))
    met = stand.join(listed, "cell")
    met = met.selectExpr("*", f"((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)) / {flat} AS w0", f"((x2 - x) * (y0 - y) - (x0 - x) * (y2 - y)) / {flat} AS w1")
    return met.where("w0 >= 0 AND w1 >= 0 AND w0 + w1 <= 1").selectExpr("column_id", "tri_id", "mesh_id", "w0 * z0 + w1 * z1 + (1 - w0 - w1) * z2 AS z")


def bounds(hits: DataFrame) -> DataFrame:
    """The lowest and highest place of each mesh in each column."""
    return hits.groupBy("column_id", "mesh_id").agg(F.min("z").alias("bottom"), F.max("z").alias("top"))


def intervals(found: DataFrame) -> DataFrame:
    """A column's meshes by height (bottom + top), with rows of mesh -1 for the gaps between them."""
    w = Window.partitionBy("column_id").orderBy(F.expr("bottom + top"), "mesh_id")
    rows = found.withColumn("below", F.lag("top").over(w))
    gaps = rows.where("bottom > below").select("column_id", F.lit(-1).cast("long").alias("mesh_id"), F.col("below").alias("bottom"), F.col("bottom").alias("top"))
    return found.select("column_id", F.col("mesh_id").cast("long").alias("mesh_id"), "bottom", "top").unionByName(gaps)


def nesting(found: DataFrame) -> DataFrame:
    """(layer, down): how far each layer (mesh_id) can sink onto the one below without touching it in any column."""
    w = Window.partitionBy("column_id").orderBy("mesh_id")
    return found.withColumn("gap", F.col("bottom") - F.lag("top").over(w)).where("gap IS NOT NULL").groupBy(F.col("mesh_id").alias("layer")).agg(F.min("gap").alias("down"))
