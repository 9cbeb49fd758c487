"""Structured grids as plain arithmetic over ``spark.range``: nothing is shuffled and any slice can be made anew.

Cells are numbered z outermost, x innermost: vid = ix + iy * nx + iz * nx * ny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _check(*sides: int) -> None:
    if any(n < 1 for n in sides):
        raise ValueError("a grid has at least one cell along each axis")


def cells(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """vid, ix, iy, iz."""
    _check(nx, ny, nz)
    return spark.range(nx * ny * nz).selectExpr("id AS vid", f"CAST(id % {nx} AS INT) AS ix", f"CAST(id div {nx} % {ny} AS INT) AS iy", f"CAST(id div {nx * ny} AS INT) AS iz")


def centres(spark: SparkSession, shape: tuple[int, int, int], lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0)) -> DataFrame:
    """Cells with the coordinates of their centres."""
    at = [f"{float(a)}D + (i{c} + 0.5D) * {float(b) - float(a)}D / {n} AS {c}" for c, n, a, b in zip("xyz", shape, lo, hi, strict=True)]
    return cells(spark, *shape).selectExpr("*", *at)


def lows(spark: SparkSession, shape: tuple[int, int, int], lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0), level: int = 0) -> DataFrame:
    """Cells by their low corner (x, y, z), size (dx, dy, dz) and level, as refinement starts from."""
    size = [(float(b) - float(a)) / n for n, a, b in zip(shape, lo, hi, strict=True)]
    return cells(spark, *shape).selectExpr("vid", *(f"{float(a)}D + i{c} * {s}D AS {c}" for c, a, s in zip("xyz", lo, size, strict=True)), *(f"{s}D AS d{c}" for c, s in zip("xyz", size, strict=True)), f"CAST({level} AS SMALLINT) AS level")


def corners(spark: SparkSession, shape: tuple[int, int, int], lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0)) -> DataFrame:
    """Nodes at i / (n - 1), both ends included; here z is innermost."""
    if any(n < 2 for n in shape):
        raise ValueError("both ends need two nodes along each axis")
    nx, ny, nz = shape
    at = [f"{float(a)}D + i{c} * {float(b) - float(a)}D / {n - 1} AS {c}" for c, n, a, b in zip("xyz", shape, lo, hi, strict=True)]
    return spark.range(nx * ny * nz).selectExpr("id AS node_id", f"id div {ny * nz} AS ix", f"id div {nz} % {ny} AS iy", f"id % {nz} AS iz").selectExpr("*", *at)


def hexes(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """Eight-node elements over the (nx + 1)(ny + 1)(nz + 1) nodes of the grid, numbered like cells."""
    node = lambda a, b, c: f"(ix + {a}) + (iy + {b}) * {nx + 1}L + (iz + {c}) * {(nx + 1) * (ny + 1)}L"
    around = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return cells(spark, nx, ny, nz).selectExpr("vid AS elem_id", f"array({', '.join(node(a, b, c) for c in (0, 1) for a, b in around)}) AS nodes")


def affine(spark: SparkSession, shape: tuple[int, int, int], origin, a, b, c) -> DataFrame:
    """Centres of a sheared or rotated grid: origin + u a + v b + w c for cell fractions u, v, w."""
    part = [f"((i{k} + 0.5D) / {n})" for k, n in zip("xyz", shape, strict=True)]
    at = [f"{float(origin[k])}D + {part[0]} * {float(a[k])}D + {part[1]} * {float(b[k])}D + {part[2]} * {float(c[k])}D AS {'xyz'[k]}" for k in range(3)]
    return cells(spark, *shape).selectExpr("*", *at)


def staggered(spark: SparkSession, shape: tuple[int, int, int], offset: float, lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0)) -> DataFrame:
    """A grid whose far side is moved by a share of its length; nx must be even and divisible by 1 / offset."""
    nx = shape[0]
    if nx % 2 or not 0 < offset < 1 or nx % round(1 / offset):
        raise ValueError("nx must be even and divisible by 1 / offset")
    return centres(spark, shape, lo, hi).withColumn("partner_ix", F.expr(f"CAST((ix + {round(nx * offset)}) % {nx} AS INT)"))


def latin_hypercube(spark: SparkSession, n: int, dimensions: int = 2, key: int = 1) -> DataFrame:
    """n samples, one in each of n slices along every axis. Slices are dealt by a hash order, so a key repeats its samples."""
    from pyspark.sql import Window

    rows = spark.range(n)
    for d in range(dimensions):
        order = F.xxhash64("id", F.lit(key), F.lit(d))
        rows = rows.withColumn(f"u{d}", (F.row_number().over(Window.orderBy(order, "id")) - F.lit(0.5)) / n)
    return rows.withColumnRenamed("id", "sample")
