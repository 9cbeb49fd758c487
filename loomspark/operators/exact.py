"""The exact point-in-yarn rule: the section plane that holds the point is searched along the path.

A yarn's path is cut into segments; a segment's box, grown by the section's radius, is listed under the lattice
cells it touches and met by the points that stand there. Between a segment's ends position and frame are
interpolated, and bisection finds where the point lies in the plane across the path; a segment whose ends see the
point on one side doesn't hold it. The deepest point - the most negative distance from the section - wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import polygons
from loomspark.operators.classify import MOST_LISTED, _bucketed, _few, images
from loomspark.operators.plan import settle

#: Halvings of a segment: the place is known to a millionth of a millionth of it.
HALVINGS = 40
_PARTS = ("x", "y", "z", "tx", "ty", "tz", "ux", "uy", "uz", "sx", "sy", "sz")


def segments(yarns: DataFrame, further: float = 0.0) -> DataFrame:
    """A row for each image's pair of successive nodes, with the box of the points it can hold, or that are ``further`` away at most."""
    rows = images(yarns).where("size(nodes) > 1").withColumn("radius", F.expr(f"sqrt(array_max(transform(section, p -> p.x * p.x + p.y * p.y))) + 1e-6D + {further!r}D"))
    rows = rows.select("yarn_id", "image", "section", "radius", F.posexplode(F.expr("transform(sequence(1, size(nodes) - 1), i -> named_struct('a', nodes[i - 1], 'b', nodes[i]))")).alias("segment", "s"))
    ends = [F.col(f"s.{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in _PARTS]
    box = [F.expr(f"least(s.a.{c}, s.b.{c}) - radius").alias(f"lo{c}") for c in "xyz"] + [F.expr(f"greatest(s.a.{c}, s.b.{c}) + radius").alias(f"hi{c}") for c in "xyz"]
    return rows.select("yarn_id", "image", "segment", "section", *ends, *box)


def _mix(c: str, u: str) -> str:
    return f"(a_{c} + (b_{c} - a_{c}) * ({u}))"


def planes(points: DataFrame, yarns: DataFrame, key: str, extent, further: float = 0.0) -> DataFrame:
    """Points met with the segments whose plane across the path, at the share ``w`` of the segment, holds them."""
    found = segments(yarns, further)
    few = _few(images(yarns))
    place, box = ["yarn_id", "image", "segment"], [f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]
    # boxes alone are listed under buckets, segments are brought to those that are met
    at, boxes = _bucketed(points, found.select(*place, *box), *extent)
    met = at.select(key, "x", "y", "z", "bucket").join(F.broadcast(boxes) if few and boxes.count() <= MOST_LISTED else boxes, "bucket")
    met = met.where("x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz").select(key, "x", "y", "z", *place)
    whole = found.drop(*box)
    met = met.join(F.broadcast(whole) if few else whole, place)
    across = lambda u: "(" + " + ".join(f"({c} - {_mix(c, u)}) * {_mix(f't{c}', u)}" for c in "xyz") + ")"
    met = settle(met, low=F.expr(across("0D")), high=F.expr(across("1D"))).where("low >= 0 AND high <= 0")
    half = f"aggregate(sequence(1, {HALVINGS}), named_struct('a', 0D, 'b', 1D), (s, i) -> CASE WHEN {across('(s.a + s.b) / 2')} > 0 THEN named_struct('a', (s.a + s.b) / 2, 'b', s.b) ELSE named_struct('a', s.a, 'b', (s.a + s.b) / 2) END, s -> (s.a + s.b) / 2)"
    return settle(met, w=F.expr(f"CASE WHEN low = 0 THEN 0D WHEN high = 0 THEN 1D ELSE {half} END"))


def hits(points: DataFrame, yarns: DataFrame, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), tolerance: float = 0.0) -> DataFrame:
    """Every (point, yarn, image) that meets: key, yarn_id, image, u, v, distance, tx, ty, tz, t (segment + share)."""
    mix = _mix
    met = planes(points, yarns, key, extent)
    local = lambda axis: "(" + " + ".join(f"({c} - {mix(c, 'w')}) * {mix(f'{axis}{c}', 'w')}" for c in "xyz") + f") / nullif(sqrt({' + '.join(f'pow({mix(f'{axis}{c}', 'w')}, 2)' for c in 'xyz')}), 0)"
    met = settle(met, u=F.expr(local("s")), v=F.expr(local("u")), **{f"t{c}": F.expr(mix(f"t{c}", "w")) for c in "xyz"})
    met = settle(met, distance=F.expr(polygons.edge_distance("section", "u", "v", "1e300D")), inside=F.expr(polygons.inside_closed("section", "u", "v")))
    # beyond the section by less than the tolerance of every edge counts as inside, if there is one
    near = (F.col("distance") < tolerance) if tolerance > 0 else F.lit(False)
    return met.where(F.col("inside") | near).select(key, "yarn_id", "image", "u", "v", "distance", "tx", "ty", "tz", (F.col("segment") + F.col("w")).alias("t"))


def point_information(points: DataFrame, yarns: DataFrame, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), tolerance: float = 0.0) -> DataFrame:
    """``points`` with the yarn that holds each deepest (-1 for none), its place in the section, tangent and distance."""
    best = hits(points, yarns, key, extent, tolerance).groupBy(key).agg(F.min(F.struct("distance", "yarn_id", "image", "u", "v", "tx", "ty", "tz", "t")).alias("best"))
    rows = points.join(best, key, "left")
    return rows.select(*points.columns, F.coalesce("best.yarn_id", F.lit(-1)).alias("yarn_id"), *(F.col(f"best.{c}").alias(c) for c in ("u", "v", "tx", "ty", "tz", "t", "distance")))


def of_yarn(points: DataFrame, yarns: DataFrame, yarn_id: int, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), tolerance: float = 0.0, assume_inside: bool = False) -> DataFrame:
    """``point_information`` of one yarn, and ``is_inside``; with ``assume_inside`` points that no section plane finds inside count as its own, without a place."""
    rows = point_information(points, yarns.where(F.col("yarn_id") == yarn_id), key, extent, tolerance).withColumn("is_inside", F.col("yarn_id") >= 0)
    return rows.withColumn("yarn_id", F.lit(yarn_id)).withColumn("is_inside", F.lit(True)) if assume_inside else rows


def first_image(points: DataFrame, yarns: DataFrame, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), tolerance: float = 0.0) -> DataFrame:
    """(key, yarn_id, image, u, v, distance, t): of a yarn's images that hold a point the first, in the order of translations."""
    found = hits(points, yarns, key, extent, tolerance).groupBy(key, "yarn_id").agg(F.min(F.struct("image", "distance", "u", "v", "t")).alias("m"))
    return found.select(key, "yarn_id", *(f"m.{c}" for c in ("image", "u", "v", "distance", "t")))


def closest_surface(points: DataFrame, yarns: DataFrame, within: float, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))) -> DataFrame:
    """(key, yarn_id, image, distance, sx, sy, sz): the nearest of the sections' points in the planes that hold a point, if it is ``within`` reach.

    The bound makes this an equi-join on lattice cells like any other meeting of points and yarns.
    """
    met = planes(points, yarns, key, extent, within)
    spot = ", ".join(f"'s{c}', {_mix(c, 'w')} + q.x * {_mix(f's{c}', 'w')} + q.y * {_mix(f'u{c}', 'w')}" for c in "xyz")
    met = settle(met, ring=F.expr(f"transform(section, q -> named_struct({spot}))"))
    nearest = "array_min(transform(ring, q -> named_struct('distance', sqrt(pow(x - q.sx, 2) + pow(y - q.sy, 2) + pow(z - q.sz, 2)), 'sx', q.sx, 'sy', q.sy, 'sz', q.sz)))"
    best = met.select(key, "yarn_id", "image", F.expr(nearest).alias("n")).where(F.col("n.distance") <= within)
    best = best.groupBy(key).agg(F.min(F.struct(F.col("n.distance").alias("distance"), "yarn_id", "image", "n.sx", "n.sy", "n.sz")).alias("m"))
    return best.select(key, "m.yarn_id", "m.image", "m.distance", "m.sx", "m.sy", "m.sz")


def interference(points: DataFrame, yarns: DataFrame, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))) -> DataFrame:
    """(key, own, yarn_id, distance): points of a yarn's surface (own) that lie inside another yarn."""
    found = hits(points, yarns, key, extent)
    return found.join(points.select(key, "own"), key).where("own != yarn_id").groupBy(key, "own", "yarn_id").agg(F.min("distance").alias("distance"))
