"""Queries over grids and the point classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import classify
from loomspark.plans.registry import register
from loomspark.session import table
from loomspark.sources import fixtures, grids

# The classifier's rule again as plain SQL over sixteen straight yarns: each point against each yarn and node.
_YARNS = "(SELECT CAST(k AS INT) AS yarn_id, 0.15 + (k // 4) * (0.7 / 3) AS yy, 0.15 + (k % 4) * (0.7 / 3) AS yz FROM range(16) t(k))"
_HIT = "abs(yy - y) < 0.035 AND abs(z - yz) < 0.035"


def _owner(points: str, key: str) -> str:
    reach = "(sqrt(2 * 0.035 * 0.035) + 1 / 30.0 + 1e-6)"
    return f"""(SELECT {key}, coalesce(CAST(min(s).y AS INT), -1) AS yarn_id FROM (
        SELECT {key}, CASE WHEN {_HIT} AND x BETWEEN -{reach} AND 1 + {reach} AND y BETWEEN yy - {reach} AND yy + {reach} AND z BETWEEN yz - {reach} AND yz + {reach}
            THEN {{'d': sqrt(pow(x - round(x * 15) / 15.0, 2) + pow(y - yy, 2) + pow(z - yz, 2)) + abs(x - round(x * 15) / 15.0) * 0.1, 'y': yarn_id}} END AS s
        FROM {points}, {_YARNS}) GROUP BY {key})"""


def _grid(n: int) -> str:
    return f"(SELECT id AS vid, (id % {n} + 0.5) / {n} AS x, (id // {n} % {n} + 0.5) / {n} AS y, (id // {n * n} + 0.5) / {n} AS z FROM range({n ** 3}) t(id))"


@register("j1_voxel_classify", f"SELECT yarn_id, count(*) AS voxels FROM {_owner(_grid(32), 'vid')} GROUP BY yarn_id")
def j1_voxel_classify(spark, sf_dir):
    return classify.voxelize(fixtures.yarn_grid(spark), 32, 32, 32).groupBy("yarn_id").agg(F.count("*").alias("voxels"))


@register("j1_voxel_classify_64", f"SELECT yarn_id, count(*) AS voxels FROM {_owner(_grid(64), 'vid')} GROUP BY yarn_id")
def j1_voxel_classify_64(spark, sf_dir):
    """The grid of the published batch's cases: 64 cells along each axis."""
    return classify.voxelize(fixtures.yarn_grid(spark), 64, 64, 64).groupBy("yarn_id").agg(F.count("*").alias("voxels"))


_LATTICE = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10000 + CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT) AS pid, (l_quantity - 1) / 49 AS x, (l_discount + 0.0) / 0.1 AS y, (l_tax + 0.0) / 0.08 AS z FROM lineitem)"


@register("j1_lineitem_points", f"SELECT yarn_id, l_linenumber, count(*) AS points FROM {_LATTICE} JOIN {_owner(_LATTICE, 'pid')} USING (pid) GROUP BY 1, 2")
def j1_lineitem_points(spark, sf_dir):
    """Points on a lattice repeat, so each place is classified once and its rows are joined to it."""
    points = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber", "CAST(l_quantity AS BIGINT) * 10000 + CAST(round(l_discount * 100) AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT) AS pid", "(l_quantity - 1) / 49 AS x", "(l_discount + 0.0D) / 0.1D AS y", "(l_tax + 0.0D) / 0.08D AS z")
    counted = points.groupBy("pid", "l_linenumber").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in "xyz"))
    places = counted.groupBy("pid").agg(*(F.min(c).alias(c) for c in "xyz"))
    owned = classify.classify(places, fixtures.yarn_grid(spark), "pid").select("pid", "yarn_id")
    return counted.join(owned, "pid").groupBy("yarn_id", "l_linenumber").agg(F.sum("n").alias("points"))


@register("a10_element_sets", f"SELECT CASE WHEN yarn_id < 0 THEN 'Matrix' ELSE 'Yarn' || yarn_id END AS set_name, vid + 1 AS elem_id FROM {_owner(_grid(16), 'vid')}")
def a10_element_sets(spark, sf_dir):
    return classify.element_sets(classify.voxelize(fixtures.yarn_grid(spark), 16, 16, 16))


@register("a2_image_boxes", f"SELECT yarn_id, round(-{0.0 + (2 * 0.035 ** 2) ** 0.5 + 1 / 30 + 1e-6}, 9)::DOUBLE AS lox, round(yy - {(2 * 0.035 ** 2) ** 0.5 + 1 / 30 + 1e-6}, 9) AS loy, round(yz + {(2 * 0.035 ** 2) ** 0.5 + 1 / 30 + 1e-6}, 9) AS hiz FROM {_YARNS}")
def a2_image_boxes(spark, sf_dir):
    return classify.images(fixtures.yarn_grid(spark)).selectExpr("yarn_id", "round(lox, 9) AS lox", "round(loy, 9) AS loy", "round(hiz, 9) AS hiz")


@register("i6_adaptive_refine")
def i6_adaptive_refine(spark, sf_dir):
    from loomspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return classify.refine(fixtures.square_yarn(spark), (2, 2, 2), 2)


def _round9(*names: str) -> list[str]:
    return [f"round({n}, 9) AS {n}" for n in names]


@register("s9_cell_centres", "SELECT id AS vid, CAST(id % 8 AS INT) AS ix, CAST(id // 8 % 6 AS INT) AS iy, CAST(id // 48 AS INT) AS iz, round((id % 8 + 0.5) / 8, 9) AS x, round(-1 + (id // 8 % 6 + 0.5) / 3, 9) AS y, round((id // 48 + 0.5::DOUBLE) * 0.75, 9) AS z FROM range(192) t(id)")
def s9_cell_centres(spark, sf_dir):
    return grids.centres(spark, (8, 6, 4), (0, -1, 0), (1, 1, 3)).selectExpr("vid", "ix", "iy", "iz", *_round9("x", "y", "z"))


@register("s10_s17_cell_lows", "SELECT id AS vid, round((id % 4) / 4.0, 9) AS x, round((id // 4 % 4) / 4.0, 9) AS y, round((id // 16) / 4.0, 9) AS z, 0.25::DOUBLE AS dx, CAST(0 AS SMALLINT) AS level FROM range(64) t(id)")
def s10_cell_lows(spark, sf_dir):
    return grids.lows(spark, (4, 4, 4)).selectExpr("vid", *_round9("x", "y", "z"), "dx", "level")


@register("s11_regular_nodes", "SELECT id AS node_id, id // 12 AS ix, id // 3 % 4 AS iy, id % 3 AS iz, round((id // 12) / 4.0, 9) AS x, round((id // 3 % 4) / 3.0, 9) AS y, round((id % 3) / 2.0, 9) AS z FROM range(60) t(id)")
def s11_regular_nodes(spark, sf_dir):
    return grids.corners(spark, (5, 4, 3)).selectExpr("node_id", "ix", "iy", "iz", *_round9("x", "y", "z"))


@register("s12_hex_elements", "SELECT id AS elem_id, k, CASE k WHEN 0 THEN b WHEN 1 THEN b + 1 WHEN 2 THEN b + 6 WHEN 3 THEN b + 5 WHEN 4 THEN b + 20 WHEN 5 THEN b + 21 WHEN 6 THEN b + 26 ELSE b + 25 END AS node FROM (SELECT id, (id % 4) + (id // 4 % 3) * 5 + (id // 12) * 20 AS b, CAST(k AS INT) AS k FROM range(24) t(id), range(8) r(k))")
def s12_hex_elements(spark, sf_dir):
    return grids.hexes(spark, 4, 3, 2).select("elem_id", F.posexplode("nodes").alias("k", "node"))


@register("s13_s14_affine_grid", "SELECT id AS vid, round((id % 4 + 0.5) / 4 + 0.3 * (id // 4 % 4 + 0.5) / 4, 9) AS x, round((id // 4 % 4 + 0.5) / 4, 9) AS y, round(0.1 * (id % 4 + 0.5) / 4 + (id // 16 + 0.5) / 2, 9) AS z FROM range(32) t(id)")
def s13_affine_grid(spark, sf_dir):
    return grids.affine(spark, (4, 4, 2), (0, 0, 0), (1, 0, 0.1), (0.3, 1, 0), (0, 0, 1)).selectExpr("vid", *_round9("x", "y", "z"))


@register("s15_staggered_grid", "SELECT id AS vid, CAST(id % 8 AS INT) AS ix, CAST((id % 8 + 2) % 8 AS INT) AS partner_ix FROM range(128) t(id)")
def s15_staggered_grid(spark, sf_dir):
    return grids.staggered(spark, (8, 4, 4), 0.25).select("vid", "ix", "partner_ix")


@register("s16_prism_cells", "SELECT id AS vid FROM range(512) t(id) WHERE (id % 8 + 0.5) / 8 + (id // 64 + 0.5) / 8 < 1.01")
def s16_prism_cells(spark, sf_dir):
    """Cells whose (x, z) lies in a triangle: the test runs on distinct columns and a semi-join keeps their cells."""
    from loomspark.functions import polygons

    cells = grids.centres(spark, (8, 8, 8))
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1.01D, 'y', 0D), named_struct('x', 0D, 'y', 1.01D))"
    columns = cells.where("iy = 0").withColumn("ring", F.expr(ring)).where(F.expr(polygons.inside_half_open("ring", "x", "z"))).select("ix", "iz")
    return cells.join(columns, ["ix", "iz"], "left_semi").select("vid")


@register("s18_latin_hypercube", "SELECT CAST(k AS INT) AS axis, i AS slice, CAST(1 AS BIGINT) AS samples FROM range(2) a(k), range(64) t(i)")
def s18_latin_hypercube(spark, sf_dir):
    """How many samples each slice of each axis has: one."""
    rows = grids.latin_hypercube(spark, 64)
    return rows.select(F.posexplode(F.array("u0", "u1")).alias("axis", "u")).select("axis", F.expr("CAST(floor(u * 64) AS BIGINT)").alias("slice")).groupBy("axis", "slice").agg(F.count("*").alias("samples"))


@register("w7_layer_windows", "SELECT CAST(i AS INT) AS layer_start, round(greatest(0.0::DOUBLE, i * 0.2::DOUBLE - 0.05), 9) AS z_lo, round(least(1.0::DOUBLE, (i + 1) * 0.2::DOUBLE + 0.05), 9) AS z_hi, 'L0' || i AS label FROM range(5) t(i)")
def w7_layer_windows(spark, sf_dir):
    """Equal slices of a unit height in five layers, each padded but not beyond the ends."""
    return spark.range(5).selectExpr("CAST(id AS INT) AS layer_start", "round(greatest(0D, id * 0.2D - 0.05D), 9) AS z_lo", "round(least(1D, (id + 1) * 0.2D + 0.05D), 9) AS z_hi", "concat('L', lpad(CAST(id AS STRING), 2, '0')) AS label")


@register("k12_corner_flags", "SELECT ix, string_agg(flag, '' ORDER BY iz) AS flags FROM (SELECT id // 9 AS ix, id % 9 AS iz, CASE WHEN abs((id % 9) / 9.0 - 0.5) < 0.24 THEN 'S' ELSE 'F' END AS flag FROM range(81) t(id)) GROUP BY ix")
def k12_corner_flags(spark, sf_dir):
    """S where a yarn holds the grid corner at i * d + lo, else F; one line for each x, z within it."""
    points = spark.range(81).selectExpr("id AS vid", "id div 9 AS ix", "id % 9 AS iz", "(id div 9) / 9D AS x", "0.5D AS y", "(id % 9) / 9D AS z")
    owned = classify.classify(points, fixtures.square_yarn(spark))
    flags = owned.groupBy("ix").agg(F.array_sort(F.collect_list(F.struct("iz", F.when(F.col("yarn_id") < 0, "F").otherwise("S").alias("flag")))).alias("row"))
    return flags.select("ix", F.expr("array_join(transform(row, r -> r.flag), '')").alias("flags"))
