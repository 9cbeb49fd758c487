"""Queries over path files, drafts, balanced octrees, deformation, knits and further exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import cells, sections
from loomspark.operators import deform, levels, octree, yarns
from loomspark.plans.registry import register
from loomspark.session import table
from loomspark.sources import drafts, exports


def _lines(df, *order: str):
    """Rows with a ``value`` as numbered lines of one file for each ``file``."""
    from pyspark.sql import Window

    return df.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy(*order)))


@register("s3_path_nodes", "SELECT CAST(s_suppkey AS INT) AS yarn_id, CAST(2 AS INT) AS section_id, CAST(k AS INT) AS node_idx, round(CASE WHEN k = 0 THEN 0 ELSE s_acctbal END, 6) AS x, CASE WHEN k = 0 THEN 0 ELSE s_nationkey END::DOUBLE AS y, 1::DOUBLE AS uz FROM supplier, range(2) t(k)")
def s3_path_nodes(spark, sf_dir):
    """Each supplier as a chain of one vector, written as a path file and read again."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), F.col("s_suppkey").alias("at"), F.expr(
        "concat('** Vector\n', s_suppkey, ', 1, 0, 0, 0, ', format_string('%.6f', s_acctbal), ', ', s_nationkey, ', 0, 0, 0, 1, 0, 0, 1\n', s_suppkey, ', 0, 1, 1\n1, 1, 0, 0, 0\n0, 0, 0, 1, 0, 2, 2\n** End')").alias("text"))
    head = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), F.lit("22\nn/a\n4, 2, 1, 0, 0, 1").alias("text"))
    text = head.unionByName(rows.withColumn("at", F.col("at").cast("long"))).select("file", "at", F.posexplode(F.split("text", "\n")).alias("k", "value"))
    nodes = drafts.parse_paths(_lines(text, "at", "k"))[1]
    return nodes.selectExpr("yarn_id", "section_id", "node_idx", "round(x, 6) AS x", "y", "uz")


@register("s4_draft_cells", "SELECT file, CAST(weft AS INT) AS weft, count(*) AS warps, CAST(sum(level) AS BIGINT) AS levels FROM (SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS weft, unnest(string_split(CAST(p_partkey AS VARCHAR), ''))::INT AS level FROM part) GROUP BY 1, 2")
def s4_draft_cells(spark, sf_dir):
    """Parts of a brand as the wefts of a draft, a digit of the key for each warp."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS file", "CAST(p_partkey AS BIGINT) AS at", "CAST(p_partkey AS STRING) AS value")
    head = rows.select("file").distinct().selectExpr("file", "-2L AS at", "'1 2 1' AS value")
    options = rows.select("file").distinct().selectExpr("file", "-1L AS at", "'WIDTH 12.5 mm' AS value")
    cells = drafts.parse_draft(_lines(head.unionByName(options).unionByName(rows), "at"))[1]
    return cells.groupBy("file", "weft").agg(F.count("*").alias("warps"), F.sum("level").alias("levels"))


@register("k21_draft_lines", "SELECT line_no, value FROM (VALUES (0::BIGINT, '01' || chr(9) || '01'), (1::BIGINT, '10' || chr(9) || '10'), (2::BIGINT, ''), (3::BIGINT, ''), (4::BIGINT, '10' || chr(9) || '10'), (5::BIGINT, '01' || chr(9) || '01')) v(line_no, value)")
def k21_draft_lines(spark, sf_dir):
    """A plain weave of two warps on two heddles."""
    plain = spark.createDataFrame([(0, "10"), (1, "01")], "row int, cells string")
    return drafts.draft_lines(spark.createDataFrame([(0, 0), (1, 1)], "warp int, heddle int"), plain, plain, 2)


def _leaves(spark, sf_dir):
    """A root of 4 x 4 x 4 cells, and under it a chain of splits towards each supplier's place."""
    deep = table(spark, sf_dir, "supplier").selectExpr("5 AS level", "s_suppkey * 37 % 128 AS ix", "s_suppkey * 53 % 128 AS iy", "s_suppkey * 71 % 128 AS iz").distinct()
    roots = spark.range(64).selectExpr("0 AS level", "id % 4 AS ix", "id div 4 % 4 AS iy", "id div 16 AS iz")
    cut = deep.selectExpr("0 AS level", "ix div 32 AS ix", "iy div 32 AS iy", "iz div 32 AS iz").distinct()
    return roots.join(cut, ["level", "ix", "iy", "iz"], "left_anti").unionByName(deep)


@register("i7_octree_volume", "SELECT CAST(64 AS DOUBLE) AS volume, true AS balanced")
def i7_octree_volume(spark, sf_dir):
    """Balanced cells fill the box once, and no two that touch are two levels apart."""
    cells = octree.balance(_leaves(spark, sf_dir), (4, 4, 4)).checkpoint()
    # A cell of level l + 2 that touches one of level l has an ancestor of its own size among that one's neighbours.
    fine = cells.where("level >= 2").selectExpr("level - 2 AS level", f"explode({octree._AROUND}) AS n").selectExpr("level", "n.ix div 4 AS ix", "n.iy div 4 AS iy", "n.iz div 4 AS iz", "n.ix >= 0 AND n.iy >= 0 AND n.iz >= 0 AS inside").where("inside")
    wrong = fine.join(cells, ["level", "ix", "iy", "iz"], "left_semi").limit(1).agg((F.count("*") == 0).alias("balanced"))
    return cells.agg(F.expr("sum(pow(8D, -level))").alias("volume")).crossJoin(wrong)


@register("j13_surface_displacement", """WITH t AS (SELECT id AS tri_id, y, (id // 2 % 5)::DOUBLE AS cx, (id // 10)::DOUBLE AS cy, id % 2 AS upper FROM range(50) r(id), range(3) q(y)),
    c AS (SELECT tri_id, y, CASE upper WHEN 0 THEN cx ELSE cx + 1 END AS x0, CASE upper WHEN 0 THEN cy ELSE cy + 1 END AS y0, cx + 1 AS x1, cy AS y1, cx AS x2, cy + 1 AS y2 FROM t),
    p AS (SELECT p_partkey AS point_id, p_partkey % 3 AS y, p_size / 7.0::DOUBLE - 1 AS px, (p_partkey % 61) / 9.7::DOUBLE - 0.5 AS py FROM part),
    w AS (SELECT point_id, tri_id, x0, y0, x1, y1, x2, y2, ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS a, ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS b FROM p JOIN c USING (y)),
    o AS (SELECT point_id, a * x0 * y0 + b * x1 * y1 + (1 - a - b) * x2 * y2 AS dz, row_number() OVER (PARTITION BY point_id ORDER BY least(a, b, 1 - a - b) DESC, tri_id) AS r, least(a, b, 1 - a - b) AS accuracy FROM w)
    SELECT point_id, round(dz, 6) AS dz, round(accuracy, 6) + 0.0 AS accuracy FROM o WHERE r = 1""")
def j13_surface_displacement(spark, sf_dir):
    """Parts as points, within and beside three yarns' surfaces of fifty triangles that move by x * y."""
    grid = spark.range(150).selectExpr("id % 50 AS tri_id", "id div 50 AS yarn_id", "CAST(id % 50 div 2 % 5 AS DOUBLE) AS cx", "CAST(id % 50 div 10 AS DOUBLE) AS cy", "id % 2 AS upper")
    tri = grid.selectExpr("tri_id", "yarn_id", "cx + upper AS x0", "cy + upper AS y0", "cx + 1 AS x1", "cy AS y1", "cx AS x2", "cy + 1 AS y2")
    tri = tri.selectExpr("*", *(f"x{k} * y{k} AS d{k}" for k in range(3)))
    points = table(spark, sf_dir, "part").selectExpr("p_partkey AS point_id", "p_partkey % 3 AS yarn_id", "p_size / 7D - 1 AS x", "(p_partkey % 61) / 9.7D - 0.5D AS y")
    return deform.surface_displacement(points, tri, 0.75).selectExpr("point_id", "round(dz, 6) AS dz", "round(accuracy, 6) + 0.0D AS accuracy")


@register("i22_deformed_heights", "SELECT node_id, round(0.5 + x * 2 - y, 6) AS z FROM (SELECT p_partkey AS node_id, p_size / 50.0::DOUBLE AS x, (p_partkey % 40) / 40.0::DOUBLE AS y FROM part)")
def i22_deformed_heights(spark, sf_dir):
    """Nodes on a square whose two triangles move by 2 x - y."""
    tri = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0, 1.0, 1.0, 1.0), (1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, -1.0)], "tri_id long, yarn_id int, x0 double, y0 double, d0 double, x1 double, y1 double, d1 double, x2 double, y2 double, d2 double")
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey AS point_id", "0 AS yarn_id", "p_size / 50D AS x", "(p_partkey % 40) / 40D AS y", "0.5D AS z")
    return deform.deform(nodes, deform.surface_displacement(nodes, tri, 0.5)).selectExpr("point_id AS node_id", "round(z, 6) AS z")


@register("j18_section_match", "SELECT vec_id AS poly_id, CAST(vec_id % 3 AS INT) AS image, CAST(vec_id % 8 AS INT) AS start_index FROM embeddings")
def j18_section_match(spark, sf_dir):
    """Each ring of eight corners among three images of it, of which one is where the ring is, turned."""
    rings = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(sequence(0, 7), i -> named_struct('x', CAST(embedding[i * 2] AS DOUBLE), 'y', CAST(embedding[i * 2 + 1] AS DOUBLE), 'z', CAST(i AS DOUBLE))) AS points")
    images = rings.select("vec_id", "points", F.explode(F.expr("sequence(0, 2)")).alias("image"))
    images = images.selectExpr("vec_id AS key", "image", "transform(sequence(0, 7), i -> named_struct('x', points[(i + vec_id % 8) % 8].x + (image - vec_id % 3) * 2, 'y', points[(i + vec_id % 8) % 8].y, 'z', points[(i + vec_id % 8) % 8].z)) AS points")
    return deform.match_sections(rings.selectExpr("vec_id AS poly_id", "vec_id AS key", "points"), images)


@register("g9_weft_knit", "SELECT CAST(i AS INT) AS node_idx, x, y, z FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.125::DOUBLE), (1, 0.375, 0.5, 0.0), (2, 0.25, 1.0, -0.125), (3, 0.125, 1.5, 0.0), (4, 0.5, 2.0, 0.125), (5, 0.875, 1.5, 0.0), (6, 0.75, 1.0, -0.125), (7, 0.625, 0.5, 0.0), (8, 1.0, 0.0, 0.125)) v(i, x, y, z)")
def g9_weft_knit(spark, sf_dir):
    return yarns.weft_knit(spark, 1.0, 2.0, 1.0, 0.25).drop("yarn_id")


def _voxels(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey - 1 AS vid", "CASE WHEN s_nationkey % 3 = 0 THEN -1 ELSE s_nationkey END AS yarn_id")


@register("k4_yarn_hexes", "SELECT row_number() OVER (ORDER BY vid) AS elem_id, vid, vid % 5 + 1 + (vid // 5 % 4) * 6 + vid // 20 * 30 + 1 AS first_node, vid % 5 + (vid // 5 % 4) * 6 + (vid // 20 + 1) * 30 + 1 AS last_node FROM (SELECT s_suppkey - 1 AS vid, s_nationkey FROM supplier) WHERE s_nationkey % 3 != 0")
def k4_yarn_hexes(spark, sf_dir):
    """Cells of yarns only, of a grid of 5 x 4 columns."""
    return exports.hex_elements(_voxels(spark, sf_dir), (5, 4, 1), "inp", matrix=False).selectExpr("elem_id", "vid", "nodes[0] AS first_node", "nodes[7] AS last_node")


@register("k4_matrix_hexes_vtu", "SELECT row_number() OVER (ORDER BY vid) AS elem_id, vid % 5 + 1 + (vid // 5 % 4) * 6 + (vid // 20 + 1) * 30 AS third_node FROM (SELECT s_suppkey - 1 AS vid, s_nationkey FROM supplier) WHERE s_nationkey % 3 = 0")
def k4_matrix_hexes_vtu(spark, sf_dir):
    return exports.hex_elements(_voxels(spark, sf_dir), (5, 4, 1), "vtu", yarn=False).selectExpr("elem_id", "nodes[2] AS third_node")


@register("k9_smesh_lines", "SELECT part, line_no, value FROM (VALUES (1, 0::BIGINT, '4 3 0 0'), (5, 0::BIGINT, '2 0'), (7, 1::BIGINT, '4 0 1 2 3'), (8, 0::BIGINT, '3 0 1 2')) v(part, line_no, value)")
def k9_smesh_lines(spark, sf_dir):
    """Counts and facets of a square and a triangle."""
    nodes = spark.range(4).selectExpr("id AS node_id", "CAST(id % 2 AS DOUBLE) AS x", "CAST(id div 2 AS DOUBLE) AS y", "0D AS z")
    faces = spark.createDataFrame([(0, "TRI", [0, 1, 2]), (1, "QUAD", [0, 1, 2, 3])], "elem_id long, type string, nodes array<long>")
    return exports.smesh_lines(nodes, faces).where("part IN (1, 5, 7, 8)")


@register("k20_material_lines", "SELECT name, CAST(line_no AS INT) AS line_no, value FROM (VALUES ('Mat0', 0, '*Material, Name=Mat0'), ('Mat0', 1, '*Elastic'), ('Mat0', 2, '3.5, 0.25'), ('Mat0', 3, '*Expansion'), ('Mat0', 4, '0.5'), ('', 0, '*Solid Section, ElSet=Matrix, Material=Mat0'), ('', 1, '1.0,'), ('', 2, '*Solid Section, ElSet=Yarn0, Material=Mat1, Orientation=Orientations'), ('', 3, '1.0,'), ('Mat1', 0, '*Material, Name=Mat1'), ('Mat1', 1, '*Elastic, type=ENGINEERING CONSTANTS'), ('Mat1', 2, '1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0'), ('Mat1', 3, '9.0'), ('Mat1', 4, '*Expansion, type=ORTHO'), ('Mat1', 5, '0.5, 0.25, 0.125')) v(name, line_no, value)")
def k20_material_lines(spark, sf_dir):
    made = [("Mat0", [3.5, 0.25], [0.5]), ("Mat1", [float(i) for i in range(1, 10)], [0.5, 0.25, 0.125])]
    materials = spark.createDataFrame(made, "name string, elastic array<double>, expansion array<double>")
    return exports.material_lines(materials, spark.createDataFrame([(-1, "Mat0"), (0, "Mat1")], "yarn_id int, material string"))


@register("s2_textile_points", "SELECT CAST(n AS INT) AS yarn_id, CAST(k AS INT) AS pt_idx, x, 2::DOUBLE AS width, 1::DOUBLE AS uz FROM (SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, s_nationkey AS file, round(s_acctbal, 6) AS x, 0 AS n FROM supplier)")
def s2_textile_points(spark, sf_dir):
    """Suppliers of a nation as the points of one yarn of a textile file, nine lines each."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file"), F.col("s_suppkey").cast("long").alias("at"), F.expr("concat(format_string('%.6f', s_acctbal), ' 1 0\n0.1\n2 0.5\n0\n0 -1 0\n0 0 1\n1 0 0\n0.7\n0.001')").alias("text"))
    files = rows.select("file").distinct()
    head = files.select("file", F.lit(-1).cast("long").alias("at"), F.lit("5.9 5.5 0.4\n1.57\n1\n1\nglass\nL\nglass 21\n0.9 0.02\n1.5\n796\n1\n198").alias("text"))
    end = files.select("file", F.lit(1 << 40).cast("long").alias("at"), F.lit("*").alias("text"))
    text = head.unionByName(rows).unionByName(end).select("file", "at", F.posexplode(F.split("text", "\n")).alias("k", "value"))
    return drafts.parse_points(_lines(text, "at", "k"))[2].selectExpr("yarn_id", "pt_idx", "x", "width", "uz")


@register("w6_merged_levels", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4::BIGINT ELSE 5::BIGINT END AS levels, CASE WHEN p_size % 2 = 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS second FROM part")
def w6_merged_levels(spark, sf_dir):
    """Six heights merged within 0.2, then divided to steps of about one.

    By hand: 0, 0.01, 1, 1.1, 3, 3.02 merge to 0, 1.05, 3.02, and 2.035 comes between; 0, 0.01, 1, 1.5, 3, 3.02 merge to
    0, 1, 1.5, 3.02, half a step isn't divided, and 2.26 comes between.
    """
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "array(3.02D, 0D, 1D, 0.01D, 1.1D + p_size % 2 * 0.4D, 3D) AS levels")
    found = levels.divide_levels(levels.merge_levels(rows, 0.2), "1D")
    return found.selectExpr("p_partkey", "CAST(size(levels) AS BIGINT) AS levels", "round(levels[1], 9) AS second")


@register("p14_open_ends", "SELECT n AS node_id FROM (SELECT unnest([l_partkey * 100 + l_suppkey % 100, 1000000000 + l_orderkey * 10 + l_linenumber]) AS n FROM lineitem) GROUP BY n HAVING count(*) = 1")
def p14_open_ends(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS elem_id", "array(l_partkey * 100 + l_suppkey % 100, 1000000000 + l_orderkey * 10 + l_linenumber) AS nodes")
    return levels.open_ends(lines)


@register("f30_f33_bezier_section", "SELECT p_partkey, CAST(i AS INT) AS i, round(CASE i % 4 WHEN 0 THEN w * cx ELSE w * cx END, 9) AS x, round(h * cy, 9) AS y FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS w, p_size / 20.0::DOUBLE AS h FROM part), (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 0.75), (2, -1.0, 0.0), (3, 0.0, -0.75)) v(i, cx, cy)")
def f30_bezier_section(spark, sf_dir):
    """Two cubics, above and below, at their ends and middles."""
    ring = "array(named_struct('x', w, 'y', 0D), named_struct('x', w, 'y', h), named_struct('x', -w, 'y', h), named_struct('x', -w, 'y', 0D), named_struct('x', -w, 'y', -h), named_struct('x', w, 'y', -h))"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 10D AS w", "p_size / 20D AS h").withColumn("ring", F.expr(ring))
    found = rows.select("p_partkey", F.posexplode(F.expr(sections.sample(lambda t: sections.bezier("ring", t), 4))).alias("i", "p"))
    return found.selectExpr("p_partkey", "i", "round(p.x, 9) + 0D AS x", "round(p.y, 9) + 0D AS y")


@register("i3_equal_distances", "SELECT DISTINCT p_size, true AS even, true AS on_outline FROM part")
def i3_equal_distances(spark, sf_dir):
    """Twelve points of ellipses: all sides as long as each other, all points on the outline."""
    rows = table(spark, sf_dir, "part").select("p_size").distinct().selectExpr("p_size", "1D AS w", "0.4D + p_size / 100D AS h")
    outline = lambda t: (f"(w / 2 * cos(2 * pi() * {t}))", f"(h / 2 * sin(2 * pi() * {t}))")
    found = rows.withColumn("r", F.expr(sections.equally_spaced(outline, 12)))
    sides = found.withColumn("d", F.expr("transform(sequence(0, 11), i -> sqrt(pow(r[i].x - r[(i + 1) % 12].x, 2) + pow(r[i].y - r[(i + 1) % 12].y, 2)))"))
    return sides.selectExpr("p_size", "array_max(d) - array_min(d) < 1e-5 AS even", "forall(r, p -> abs(4 * p.x * p.x / (w * w) + 4 * p.y * p.y / (h * h) - 1) < 1e-9) AS on_outline")


@register("f39_spline_points")
def f39_spline_points(spark, sf_dir):
    from loomspark.plans.models import paths

    return yarns.spline_points(paths(spark, sf_dir), 3).selectExpr("yarn_id", "segment", "j", "round(x, 6) AS x", "round(z, 6) AS z")


@register("g3_cell_edits", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'XYX' WHEN 1 THEN 'YXX' ELSE 'XXY' END AS down, CASE p_size % 3 WHEN 0 THEN 'XYX' WHEN 1 THEN 'XXY' ELSE 'YXX' END AS up, 'XYXYY' AS added, 'XX' AS fewer FROM part")
def g3_cell_edits(spark, sf_dir):
    """A cell of three yarns pushed down and up, with two layers more, and without its only weft."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 3 AS k", "array('X', 'Y', 'X') AS c")
    edits = (("down", cells.push_down("c", "k")), ("up", cells.push_up("c", "k")), ("added", cells.add_layers("c", "'Y'", 2)), ("fewer", cells.delete_layers("c", "'Y'", 1)))
    return rows.selectExpr("p_partkey", *(f"array_join({e}, '') AS {n}" for n, e in edits))


@register("k10_mixed_elements", "SELECT row_number() OVER (ORDER BY place, id) AS number, kind, first_node FROM (SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 4 END AS place, CASE p_size % 4 WHEN 1 THEN 'C3D4' WHEN 2 THEN 'C3D6' ELSE 'S4R' END AS kind, CASE p_size % 4 WHEN 2 THEN p_partkey + 4 ELSE p_partkey + 1 END AS first_node FROM part WHERE p_size % 4 != 0)")
def k10_mixed_elements(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS elem_id", "element_at(array('LINE', 'TET', 'WEDGE', 'QUAD'), p_size % 4 + 1) AS type")
    rows = rows.withColumn("nodes", F.expr("sequence(elem_id, elem_id + CASE type WHEN 'WEDGE' THEN 5 WHEN 'LINE' THEN 1 ELSE 3 END)"))
    return exports.mixed_elements(rows).selectExpr("number", "kind", "nodes[0] AS first_node")


@register("k6_matrix_sets", "SELECT CAST(line_no AS INT) AS line_no, value FROM (VALUES (0, '*ElSet, ElSet=Matrix, Generate'), (1, '1, 24, 1'), (2, '*NSet, NSet=AllNodes, Generate'), (3, '1, 60, 1')) v(line_no, value)")
def k6_matrix_sets(spark, sf_dir):
    return exports.matrix_set_lines(spark, (2, 3, 4))


@register("f46_moved_nodes", "SELECT p_partkey, round(1 - p_size / 5.0::DOUBLE, 9) + 0.0 AS x, round(p_partkey % 7 - 1.0::DOUBLE, 9) + 0.0 AS y, 2.5::DOUBLE AS z FROM part")
def f46_moved_nodes(spark, sf_dir):
    """A quarter turn about the upright line through (1, 0, 0), then two up."""
    from math import pi

    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 7 AS DOUBLE) AS x", "p_size / 5D AS y", "0.5D AS z")
    return deform.move(nodes, (0, 0, 3), pi / 2, (1, 0, 0), (0, 0, 2)).selectExpr("p_partkey", *(f"round({c}, 9) + 0D AS {c}" for c in "xyz"))


@register("j17_section_elements", "SELECT point_id, CASE WHEN x < 1 THEN 'TRI' ELSE 'QUAD' END AS type, CASE WHEN x >= 1 THEN 0 WHEN x + y < 1 THEN 0 ELSE 1 END AS elem_id FROM (SELECT p_partkey AS point_id, p_size / 20.3::DOUBLE AS x, (p_partkey % 17) / 17.0::DOUBLE + 0.011 AS y FROM part) WHERE x < 2 AND y < 1")
def j17_section_elements(spark, sf_dir):
    """Parts as points in a unit square of two triangles and, beside it, one quad."""
    p = lambda *v: [(float(a), float(b)) for a, b in v]
    made = [(0, "TRI", 0, p((0, 0), (1, 0), (0, 1))), (0, "TRI", 1, p((1, 0), (1, 1), (0, 1))), (0, "QUAD", 0, p((1, 0), (2, 0), (2, 1), (1, 1)))]
    elements = spark.createDataFrame(made, "key int, type string, elem_id int, ring array<struct<x:double,y:double>>")
    points = table(spark, sf_dir, "part").selectExpr("p_partkey AS point_id", "0 AS key", "p_size / 20.3D AS x", "(p_partkey % 17) / 17D + 0.011D AS y")
    return deform.section_elements(points, elements)
