"""Queries over the exact point rule, rays, exports and model editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import exact, rays, yarns
from loomspark.plans.fields import _YARNS, _grid
from loomspark.plans.meshes import NODES, nodes
from loomspark.plans.registry import register
from loomspark.session import table
from loomspark.sources import exports, fixtures, grids

_DEPTH = "greatest(abs(y - yy), abs(z - yz)) - {half}"


def _deepest(points: str, half: float) -> str:
    d = _DEPTH.format(half=half)
    return f"(SELECT vid, coalesce(min(CASE WHEN {d} < 0 AND x BETWEEN 0 AND 1 THEN {{'d': {d}, 'y': yarn_id}} END).y, -1) AS yarn_id, min(CASE WHEN {d} < 0 AND x BETWEEN 0 AND 1 THEN {d} END) AS distance FROM {points}, {_YARNS} GROUP BY vid)"


#: Off the yarns' planes of symmetry, where two are equally deep.
_MOVED = f"(SELECT vid, x, y + 0.011 AS y, z + 0.023 AS z FROM {_grid(24)})"


@register("j2_j3_point_information", f"SELECT vid, CAST(yarn_id AS INT) AS yarn_id, round(distance, 7) AS distance FROM {_deepest(_MOVED, 0.15)}")
def j2_point_information(spark, sf_dir):
    """Wide yarns that overlap: the deepest wins."""
    points = grids.centres(spark, (24, 24, 24), (0, 0.011, 0.023), (1, 1.011, 1.023))
    return exact.point_information(points, fixtures.yarn_grid(spark, half=0.15)).selectExpr("vid", "yarn_id", "round(distance, 7) AS distance")


_RING = f"(SELECT vid, x, y, z, vid % 16 AS own FROM {_grid(16)})"


@register("j8_interference", f"SELECT vid, own, yarn_id, round({_DEPTH.format(half=0.15)}, 7) AS distance FROM {_RING}, {_YARNS} WHERE own != yarn_id AND {_DEPTH.format(half=0.15)} < 0")
def j8_interference(spark, sf_dir):
    points = grids.centres(spark, (16, 16, 16)).withColumn("own", F.expr("vid % 16"))
    return exact.interference(points, fixtures.yarn_grid(spark, half=0.15)).selectExpr("vid", "own", "yarn_id", "round(distance, 7) AS distance")


_TRI = f"(SELECT a.node_id AS tri_id, a.node_id % 4 AS mesh_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM {NODES} a JOIN {NODES} b ON b.node_id = a.node_id + 1 JOIN {NODES} c ON c.node_id = a.node_id + 2)"
_COLUMNS = "(SELECT id AS column_id, -0.4 + (id % 20) * 0.0413 AS x, -0.4 + (id // 20) * 0.0407 AS y FROM range(400) t(id))"
_FLAT = "((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))"
_HITS = f"""(SELECT column_id, tri_id, mesh_id, w0 * z0 + w1 * z1 + (1 - w0 - w1) * z2 AS z FROM (SELECT *, ((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)) / {_FLAT} AS w0, ((x2 - x) * (y0 - y) - (x0 - x) * (y2 - y)) / {_FLAT} AS w1
    FROM {_COLUMNS}, {_TRI} WHERE abs({_FLAT}) > 1e-9) WHERE w0 >= 0 AND w1 >= 0 AND w0 + w1 <= 1)"""


def _hits(spark, sf_dir):
    at = nodes(spark, sf_dir).select("node_id", "x", "y", "z")
    tri = at.selectExpr("node_id AS tri_id", "node_id % 4 AS mesh_id", "x AS x0", "y AS y0", "z AS z0")
    for k in (1, 2):
        tri = tri.join(at.selectExpr(f"node_id - {k} AS tri_id", f"x AS x{k}", f"y AS y{k}", f"z AS z{k}"), "tri_id")
    columns = spark.range(400).selectExpr("id AS column_id", "-0.4D + (id % 20) * 0.0413D AS x", "-0.4D + (id div 20) * 0.0407D AS y")
    return rays.vertical_hits(columns, tri, ((-0.5, -0.5), (0.5, 0.5)))


@register("j6_o1_ray_hits", f"SELECT column_id, tri_id, round(z, 6) AS z FROM {_HITS}")
def j6_ray_hits(spark, sf_dir):
    return _hits(spark, sf_dir).selectExpr("column_id", "tri_id", "round(z, 6) AS z")


@register("j7_vertical_bounds", f"SELECT column_id, mesh_id, round(min(z), 6) AS bottom, round(max(z), 6) AS top FROM {_HITS} GROUP BY 1, 2")
def j7_vertical_bounds(spark, sf_dir):
    return rays.bounds(_hits(spark, sf_dir)).selectExpr("column_id", "mesh_id", "round(bottom, 6) AS bottom", "round(top, 6) AS top")


@register("k13_o4_grid_columns", f"""WITH b AS (SELECT column_id, mesh_id, min(z) AS bottom, max(z) AS top FROM {_HITS} GROUP BY 1, 2), r AS (SELECT *, lag(top) OVER (PARTITION BY column_id ORDER BY bottom + top, mesh_id) AS below FROM b)
    SELECT column_id, mesh_id, round(bottom, 6) AS bottom, round(top, 6) AS top FROM b UNION ALL SELECT column_id, -1, round(below, 6), round(bottom, 6) FROM r WHERE bottom > below""")
def k13_grid_columns(spark, sf_dir):
    return rays.intervals(rays.bounds(_hits(spark, sf_dir))).selectExpr("column_id", "mesh_id", "round(bottom, 6) AS bottom", "round(top, 6) AS top")


@register("j22_layer_nesting", f"WITH b AS (SELECT column_id, mesh_id, min(z) AS bottom, max(z) AS top FROM {_HITS} GROUP BY 1, 2) SELECT mesh_id AS layer, round(min(gap), 6) AS down FROM (SELECT mesh_id, bottom - lag(top) OVER (PARTITION BY column_id ORDER BY mesh_id) AS gap FROM b) WHERE gap IS NOT NULL GROUP BY 1")
def j22_layer_nesting(spark, sf_dir):
    return rays.nesting(rays.bounds(_hits(spark, sf_dir))).selectExpr("layer", "round(down, 6) AS down")


@register("k5_orientation_lines", "SELECT p_partkey AS line_no, printf('%d, %.6f, %.6f, %.6f, %.6f, %.6f, %.6f', p_partkey, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 0 END::DOUBLE, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END::DOUBLE) AS value FROM part")
def k5_orientation_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey - 1 AS vid", "1D AS tx", "0D AS ty", "0D AS tz", "0D AS ux", "CASE WHEN p_size % 2 = 0 THEN 0D ELSE 2D END AS uy", "CASE WHEN p_size % 2 = 0 THEN 2D ELSE 0D END AS uz")
    return exports.orientation_lines(rows).withColumn("value", F.regexp_replace("value", "-0\\.000000", "0.000000"))


@register("k7_vtk_cells", "SELECT p_partkey AS elem_id, CAST(sum(CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 6 END) OVER (ORDER BY p_partkey) AS BIGINT) AS offset, CASE p_size % 3 WHEN 0 THEN 12 WHEN 1 THEN 10 ELSE 13 END AS code FROM part".replace("AS offset", 'AS "offset"'))
def k7_vtk_cells(spark, sf_dir):
    kinds = "CASE p_size % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END"
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS elem_id", kinds.format("HEX", "TET", "WEDGE") + " AS type", "sequence(1, CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 6 END) AS nodes")
    return exports.vtk_cells(rows)


@register("k8_stl_facets")
def k8_stl_facets(spark, sf_dir):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "tri_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    return exports.stl_facets(rows)


@register("g8_layered_model", "SELECT CAST(y + l * 4 AS INT) AS yarn_id, CAST(count(*) AS BIGINT) AS nodes, l * 0.25::DOUBLE AS moved FROM range(4) a(y), range(3) b(l), range(3) c(n) GROUP BY y, l")
def g8_layered_model(spark, sf_dir):
    one = yarns.weave(spark, 2, 2, 1.0, 0.2, ((0, 0), (1, 1)))
    rows = yarns.layered([(one, (0, 0, 0.25 * k)) for k in range(3)])
    return rows.groupBy("yarn_id", "layer").agg(F.count("*").alias("nodes")).selectExpr("yarn_id", "nodes", "layer * 0.25D AS moved")


@register("g11_edit_nodes", "SELECT CAST(y AS INT) AS yarn_id, CAST(i AS INT) AS node_idx, CASE i WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 10 ELSE 99 END::DOUBLE AS x FROM range(3) a(y), range(4) b(i)")
def g11_edit_nodes(spark, sf_dir):
    """Of nodes at 0, 10, 20, 30: one goes in before 10, 20 goes, 30 becomes 99."""
    base = spark.range(12).selectExpr("CAST(id div 4 AS INT) AS yarn_id", "CAST(id % 4 AS INT) AS node_idx", "CAST(id % 4 * 10 AS DOUBLE) AS x")
    ids = spark.range(3).selectExpr("CAST(id AS INT) AS yarn_id")
    at = lambda k, x: ids.selectExpr("yarn_id", f"{k} AS node_idx", f"{x}D AS x")
    return yarns.edit_nodes(base, insert=at(1, 50), delete=at(2, 0).select("yarn_id", "node_idx"), replace=at(3, 99))


@register("g4d_next_filled_cell", "WITH c AS (SELECT s_nationkey AS row, s_suppkey AS col, CASE WHEN s_suppkey % 3 != 0 THEN 'X' END AS kind FROM supplier) SELECT row, col, coalesce((SELECT min(d.col) FROM c d WHERE d.row = c.row AND d.col > c.col AND d.kind IS NOT NULL), (SELECT min(d.col) FROM c d WHERE d.row = c.row AND d.kind IS NOT NULL)) AS following FROM c".replace(" row", " rw").replace(".row", ".rw").replace("SELECT rw", "SELECT rw").replace("AS rw", "AS rw"))
def g4d_next_filled_cell(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS row", "s_suppkey AS col", "CASE WHEN s_suppkey % 3 != 0 THEN 'X' END AS kind")
    return yarns.next_filled(cells).select(F.col("row").alias("rw"), "col", "following")
