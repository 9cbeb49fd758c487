"""Queries over clipping, equations, lookups and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import lookup
from loomspark.operators import clip, mesh
from loomspark.plans.meshes import NODES, TRIANGLES, nodes, triangles
from loomspark.plans.registry import register
from loomspark.plans.scalars import EDGES, points
from loomspark.plans.spatial import _TRI
from loomspark.session import table
from loomspark.sources import grids

_CROSS = "sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2"


@register("i11_clip_triangles", f"""WITH t AS (SELECT tri_id, {_CROSS} AS area, x0 * 0.6 + z0 * 0.8 - 0.01 AS a, x1 * 0.6 + z1 * 0.8 - 0.01 AS b, x2 * 0.6 + z2 * 0.8 - 0.01 AS c FROM {_TRI}),
    k AS (SELECT *, (a >= 0)::INT + (b >= 0)::INT + (c >= 0)::INT AS n, CASE WHEN (b >= 0) = (c >= 0) THEN a WHEN (a >= 0) = (c >= 0) THEN b ELSE c END AS p, CASE WHEN (b >= 0) = (c >= 0) THEN b WHEN (a >= 0) = (c >= 0) THEN c ELSE a END AS q, CASE WHEN (b >= 0) = (c >= 0) THEN c WHEN (a >= 0) = (c >= 0) THEN a ELSE b END AS r FROM t)
    SELECT tri_id, CASE n WHEN 2 THEN 2 ELSE 1 END::BIGINT AS parts, round(area * CASE n WHEN 3 THEN 1 WHEN 1 THEN p / (p - q) * p / (p - r) ELSE 1 - p / (p - q) * p / (p - r) END, 7) AS area FROM k WHERE n > 0""")
def i11_clip_triangles(spark, sf_dir):
    at = nodes(spark, sf_dir).select("node_id", "x", "y", "z")
    tri = at.selectExpr("node_id AS tri_id", "x AS x0", "y AS y0", "z AS z0")
    for k in (1, 2):
        tri = tri.join(at.selectExpr(f"node_id - {k} AS tri_id", f"x AS x{k}", f"y AS y{k}", f"z AS z{k}"), "tri_id")
    cut = clip.areas(clip.clip_triangles(tri, (0.6, 0.0, 0.8), 0.01))
    return cut.groupBy("tri_id").agg(F.count("*").alias("parts"), F.round(F.sum("area"), 7).alias("area"))


@register("i23_periodic_equations", "SELECT id AS a, id + 4 AS b, CAST(dof AS INT) AS dof, CAST(term AS INT) AS term, CASE term WHEN 1 THEN CAST(id + 4 AS VARCHAR) WHEN 2 THEN CAST(id AS VARCHAR) ELSE 'Driver' || dof END AS node, CASE term WHEN 1 THEN 1 ELSE -1 END::DOUBLE AS factor FROM range(125) t(id), range(1, 4) d(dof), range(1, 4) e(term) WHERE id % 5 = 0")
def i23_periodic_equations(spark, sf_dir):
    """Between the faces x = 0 and x = 1 of a cube of 125 nodes."""
    at = spark.range(125).selectExpr("id AS node_id", "(id % 5) / 4D AS x", "(id div 5 % 5) / 4D AS y", "(id div 25) / 4D AS z")
    return clip.periodic_equations(mesh.translated_pairs(at, (1, 0, 0), 1e-3), ("Driver1", "Driver2", "Driver3"))


@register("k2_u14_corner_nodes", "SELECT CAST(216 AS BIGINT) AS nodes, CAST(125 AS BIGINT) AS elements, CAST(216 AS BIGINT) AS used")
def k2_corner_nodes(spark, sf_dir):
    """Corners of 125 cells as nodes: each of the 216 places once, and all of them used."""
    at, elements = clip.number_corners(grids.lows(spark, (5, 5, 5)).withColumnRenamed("vid", "cell_id"))
    return at.agg(F.count("*").alias("nodes")).crossJoin(elements.agg(F.count("*").alias("elements"))).crossJoin(elements.select(F.explode("nodes").alias("n")).agg(F.count_distinct("n").alias("used")))


@register("a20_refinement_seed", f"WITH e AS (SELECT DISTINCT least(n0, n1) AS a, greatest(n0, n1) AS b FROM {TRIANGLES} WHERE n0 != n1), l AS (SELECT a, b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS len FROM e JOIN {NODES} p ON p.node_id = a JOIN {NODES} q ON q.node_id = b) SELECT node_id, round(avg(len), 7) AS seed FROM (SELECT a AS node_id, len FROM l UNION ALL SELECT b, len FROM l) GROUP BY node_id")
def a20_refinement_seed(spark, sf_dir):
    """The mean length of the edges at each node."""
    at = nodes(spark, sf_dir)
    edges = triangles(spark, sf_dir).selectExpr("least(nodes[0], nodes[1]) AS a", "greatest(nodes[0], nodes[1]) AS b").where("a != b").distinct()
    ends = edges.join(at.selectExpr("node_id AS a", "x AS ax", "y AS ay", "z AS az"), "a").join(at.selectExpr("node_id AS b", "x", "y", "z"), "b")
    sized = ends.withColumn("len", F.expr("sqrt(pow(ax - x, 2) + pow(ay - y, 2) + pow(az - z, 2))"))
    return sized.select(F.explode(F.array("a", "b")).alias("node_id"), "len").groupBy("node_id").agg(F.round(F.avg("len"), 7).alias("seed"))


@register("w3_f29_polygon_parameter", f"SELECT vec_id, CAST(i AS INT) AS i, round((sum(l) OVER (PARTITION BY vec_id ORDER BY i) - l) / sum(l) OVER (PARTITION BY vec_id), 7) AS t FROM (SELECT vec_id, i, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l FROM {EDGES})")
def w3_polygon_parameter(spark, sf_dir):
    """Each corner's share of the way round."""
    length = "sqrt(pow(ring[(k + 1) % size(ring)].x - ring[k].x, 2) + pow(ring[(k + 1) % size(ring)].y - ring[k].y, 2))"
    upto = f"aggregate(sequence(0, size(ring) - 1), 0D, (s, k) -> s + CASE WHEN k < i THEN {length} ELSE 0D END)"
    whole = f"aggregate(sequence(0, size(ring) - 1), 0D, (s, k) -> s + {length})"
    return points(spark, sf_dir).select("vec_id", F.explode(F.expr(f"transform(sequence(0, size(ring) - 1), i -> named_struct('i', i, 't', round({upto} / {whole}, 7)))")).alias("p")).select("vec_id", "p.i", "p.t")


@register("f36_f40_tabulated_offset", "SELECT p_partkey, round(CASE WHEN u <= 0.2 THEN 1 + (u - 0.1) / 0.1 * (3 - 1) WHEN u <= 0.6 THEN 3 + (u - 0.2) / 0.4 * (0.5 - 3) ELSE 0.5 END * CASE WHEN u < 0.1 THEN 0 ELSE 1 END + CASE WHEN u < 0.1 THEN 1 ELSE 0 END, 7) AS moved FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS u FROM part)")
def f36_tabulated_offset(spark, sf_dir):
    entries = "array(named_struct('u', 0.1D, 'v', 1D), named_struct('u', 0.2D, 'v', 3D), named_struct('u', 0.6D, 'v', 0.5D))"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 50D AS u", f"{entries} AS entries").selectExpr("p_partkey", f"round({lookup.interpolate('entries', 'u')}, 7) AS moved")


@register("i4_image_limits", "SELECT p_partkey, CAST(ceil((0 - p_size / 10.0::DOUBLE) / 1.5) AS INT) AS first_image, CAST(floor((4 + p_size / 10.0::DOUBLE) / 1.5) AS INT) AS last_image FROM part")
def i4_image_limits(spark, sf_dir):
    """Along one repeat of 1.5: which images of a yarn p_size / 10 wide, about 0, reach into 0 ... 4."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 10D AS half").selectExpr("p_partkey", "CAST(ceil(-half / 1.5D) AS INT) AS first_image", "CAST(floor((4 + half) / 1.5D) AS INT) AS last_image")


@register("j16_section_interval", f"SELECT elem_id, min(i) AS section FROM {TRIANGLES}, (VALUES (0, 0, 6), (1, 3, 9), (2, 5, 12)) v(i, lo, hi) WHERE least(n0, n1, n2) >= lo AND greatest(n0, n1, n2) <= hi GROUP BY elem_id")
def j16_section_interval(spark, sf_dir):
    """The first interval of node ids that holds all of an element's."""
    spans = "array(named_struct('i', 0, 'lo', 0, 'hi', 6), named_struct('i', 1, 'lo', 3, 'hi', 9), named_struct('i', 2, 'lo', 5, 'hi', 12))"
    found = triangles(spark, sf_dir).selectExpr("elem_id", f"array_min(transform(filter({spans}, s -> array_min(nodes) >= s.lo AND array_max(nodes) <= s.hi), s -> s.i)) AS section")
    return found.where("section IS NOT NULL")


_TOP, _LOW = "(ix * 7 + iy * 3) % 11", "20 + (ix * 5 + iy * 2) % 13"


@register("j22b_best_shift", f"WITH t AS (SELECT id // 8 AS ix, id % 8 AS iy, {_TOP.replace('ix', '(id // 8)').replace('iy', '(id % 8)')} AS top, {_LOW.replace('ix', '(id // 8)').replace('iy', '(id % 8)')} AS low FROM range(64) r(id)), s AS (SELECT dx, dy, min(b.low - a.top) AS gap FROM t a, range(8) p(dx), range(8) q(dy), t b WHERE b.ix = (a.ix + dx) % 8 AND b.iy = (a.iy + dy) % 8 GROUP BY dx, dy) SELECT dx, dy, gap FROM s ORDER BY gap DESC, dx, dy LIMIT 1")
def j22b_best_shift(spark, sf_dir):
    """The cyclic shift of the upper layer whose least gap is largest; the first of several as good."""
    cells = spark.range(64).selectExpr("id div 8 AS ix", "id % 8 AS iy").selectExpr("ix", "iy", f"{_TOP} AS top", f"{_LOW} AS low")
    shifts = spark.range(64).selectExpr("id div 8 AS dx", "id % 8 AS dy")
    moved = cells.select("ix", "iy", "top").crossJoin(shifts).selectExpr("dx", "dy", "top", "(ix + dx) % 8 AS ix", "(iy + dy) % 8 AS iy")
    gaps = moved.join(cells.select("ix", "iy", "low"), ["ix", "iy"]).groupBy("dx", "dy").agg(F.min(F.col("low") - F.col("top")).alias("gap"))
    return gaps.agg(F.max_by(F.struct("dx", "dy", "gap"), F.struct("gap", -F.col("dx"), -F.col("dy"))).alias("s")).select("s.dx", "s.dy", "s.gap")


@register("o8_trailing_integer", "SELECT p_name, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(p_name, '(\\d+)$', 1) AS INT), p_name) AS INT) AS place FROM (SELECT DISTINCT 'Yarn' || (p_partkey % 120) AS p_name FROM part)")
def o8_trailing_integer(spark, sf_dir):
    """Set names by the number at their end; a model has few."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").selectExpr("concat('Yarn', p_partkey % 120) AS p_name").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(F.regexp_extract("p_name", r"(\d+)$", 1).cast("int"), "p_name")))
