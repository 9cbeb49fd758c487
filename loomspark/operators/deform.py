"""Displacements of points by those of a solved surface, and sections found again among their images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import polygons, vec

#: Sections whose corners are this far apart are the same.
SECTION_TOLERANCE = 1e-7


def surface_displacement(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """point_id, dz, accuracy: the height that a yarn's surface moves by at each point.

    points(point_id, yarn_id, x, y); triangles(tri_id, yarn_id, x0, y0, d0, ... d2). Of the triangles of its yarn a
    point takes that whose least barycentric weight is largest; the first of several as good. ``accuracy`` is that
    weight, negative outside all triangles. Triangles are filed under the lattice cells their boxes touch, so a point
    meets those near it; only points outside all of them meet their whole yarn. Triangles without area give nothing,
    and points of yarns without a triangle are left out.
    """
    den = "nullif((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2), 0D)"
    weights = (f"((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / {den}", f"((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / {den}")

    def best(met: DataFrame) -> DataFrame:
        w = met.selectExpr("point_id", "tri_id", "d0", "d1", "d2", f"{weights[0]} AS a", f"{weights[1]} AS b").where("a IS NOT NULL").withColumn("c", F.expr("1 - a - b"))
        found = w.selectExpr("point_id", "-tri_id AS turn", "least(a, b, c) AS accuracy", "a * d0 + b * d1 + c * d2 AS dz")
        return found.groupBy("point_id").agg(F.max(F.struct("accuracy", "turn", "dz")).alias("s")).select("point_id", "s.dz", "s.accuracy")

    corners = ["x0", "y0", "d0", "x1", "y1", "d1", "x2", "y2", "d2"]
    triangles = triangles.select("tri_id", "yarn_id", *corners)
    span = lambda c: f"sequence(CAST(floor(least({c}0, {c}1, {c}2) / {cell}D) AS BIGINT), CAST(floor(greatest({c}0, {c}1, {c}2) / {cell}D) AS BIGINT))"
    filed = triangles.select("*", F.explode(F.expr(span("x"))).alias("cx")).select("*", F.explode(F.expr(span("y"))).alias("cy"))
    placed = points.selectExpr("point_id", "yarn_id", "x", "y", f"CAST(floor(x / {cell}D) AS BIGINT) AS cx", f"CAST(floor(y / {cell}D) AS BIGINT) AS cy")
    inside = best(placed.join(filed, ["yarn_id", "cx", "cy"])).where("accuracy >= 0")
    outside = best(points.select("point_id", "yarn_id", "x", "y").join(inside, "point_id", "left_anti").join(triangles, "yarn_id"))
    return inside.unionByName(outside)


def deform(nodes: DataFrame, moved: DataFrame, key: str = "point_id") -> DataFrame:
    """The nodes (``key``, x, y, z) with their heights moved; those without a displacement stay."""
    return nodes.join(moved.select(key, "dz"), key, "left").withColumn("z", F.expr("z + coalesce(dz, 0D)")).drop("dz")


def match_sections(polygons: DataFrame, sections: DataFrame, tolerance: float = SECTION_TOLERANCE) -> DataFrame:
    """poly_id, image, start_index: the first image of its section that a polygon is, turned by so many corners.

    polygons(poly_id, key, points) and sections(key, image, points), points an array of (x, y, z); they meet where key
    and number of corners agree. The start is the first corner within the tolerance of the section's first, and from
    there all must agree. Polygons without a match, and empty ones, are left out.
    """
    apart = lambda p, q: f"sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2) + pow({p}.z - {q}.z, 2))"
    left = polygons.selectExpr("poly_id", "key", "points AS p", "size(points) AS n").where("n > 0")
    right = sections.selectExpr("key", "image", "points AS s", "size(points) AS n")
    start = f"array_position(transform(p, q -> {apart('q', 's[0]')} < {tolerance}D), true) - 1"
    met = left.join(right, ["key", "n"]).withColumn("start_index", F.expr(f"CAST({start} AS INT)")).where("start_index >= 0")
    same = f"forall(sequence(0, n - 1), i -> {apart('s[i]', 'p[(start_index + i) % n]')} <= {tolerance}D)"
    return met.where(same).groupBy("poly_id").agg(F.min(F.struct("image", "start_index")).alias("m")).select("poly_id", "m.image", "m.start_index")


def move(nodes: DataFrame, axis: tuple[float, float, float], angle: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Nodes (x, y, z and further columns) turned about an axis through ``origin``, then shifted; vectors turn alike without either."""
    text = lambda v: tuple(f"CAST({float(c)!r} AS DOUBLE)" for c in v)
    q = vec.quaternion(text(axis), text((angle,))[0])
    placed = vec.add(vec.add(vec.rotate(q, vec.sub(("x", "y", "z"), text(origin))), text(origin)), text(shift))
    return nodes.select(*(F.expr(placed["xyz".index(c)]).alias(c) if c in ("x", "y", "z") else F.col(c) for c in nodes.columns))


def section_elements(points: DataFrame, elements: DataFrame) -> DataFrame:
    """point_id, type, elem_id: the element of its section's mesh that a point is in.

    points(point_id, key, x, y); elements(key, type, elem_id, ring), rings arrays of (x, y). Triangles come before quads
    and then smaller numbers; points outside all elements are left out. A section has few elements, so points meet
    those of their key.
    """
    met = points.select("point_id", "key", "x", "y").join(elements.where(F.col("type").isin("TRI", "QUAD")).select("key", "type", "elem_id", "ring"), "key")
    inside = met.where("size(ring) > 2").where(polygons.inside_closed("ring", "x", "y"))
    first = F.min(F.struct((F.col("type") == "QUAD").alias("late"), "elem_id", "type"))
    return inside.groupBy("point_id").agg(first.alias("s")).select("point_id", "s.type", "s.elem_id")
