"""Queries over meshes: points of ``embeddings`` as nodes, keys of ``lineitem`` as faces, and grids of hexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import mesh
from loomspark.plans.registry import register
from loomspark.session import table
from loomspark.sources import grids

NODES = "(SELECT vec_id AS node_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"
#: Faces with all that goes wrong: repeats, turned and opposing ones, and ones that use a node twice.
TRIANGLES = "(SELECT elem_id, [n0, n1, n2] AS nodes, n0, n1, n2 FROM (SELECT l_orderkey * 8 + l_linenumber AS elem_id, min(l_partkey) % 13 AS n0, min(l_suppkey) % 11 AS n1, min(l_orderkey) % 12 AS n2 FROM lineitem GROUP BY 1))"


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS node_id", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y", "CAST(embedding[2] AS DOUBLE) AS z", "label")


def triangles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey * 8 + l_linenumber").alias("elem_id"))
    return lines.agg(F.expr("array(min(l_partkey) % 13, min(l_suppkey) % 11, min(l_orderkey) % 12)").alias("nodes"))


def _shown(df, *names, digits=9):
    return df.selectExpr(*(f"round({n}, {digits}) AS {n}" for n in names))


@register("a1_box", f"SELECT label, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z FROM {NODES} GROUP BY label")
def a1_box(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("label").agg(*(F.min(c).alias(f"lo_{c}") for c in "xyz"), *(F.max(c).alias(f"hi_{c}") for c in "xyz"))


@register("a11_approximate_size", f"SELECT round(sqrt(pow(greatest(0, max(x)) - least(0, min(x)), 2) + pow(greatest(0, max(y)) - least(0, min(y)), 2) + pow(greatest(0, max(z)) - least(0, min(z)), 2)), 9) AS size FROM {NODES}")
def a11_approximate_size(spark, sf_dir):
    return _shown(mesh.approximate_size(nodes(spark, sf_dir)), "size")


@register("a4_centroids", f"SELECT elem_id, round(avg(x), 7) AS x, round(avg(y), 7) AS y, round(avg(z), 7) AS z FROM (SELECT elem_id, unnest(nodes) AS node_id FROM {TRIANGLES}) JOIN {NODES} USING (node_id) GROUP BY elem_id")
def a4_centroids(spark, sf_dir):
    return mesh.centroids(nodes(spark, sf_dir), triangles(spark, sf_dir)).selectExpr("elem_id", *(f"round({c}, 7) AS {c}" for c in "xyz"))


@register("a3_a24_volume", "SELECT 1.0::DOUBLE AS volume")
def a3_volume(spark, sf_dir):
    """Of the unit cube's surface, cut out of a grid of hexes."""
    hexes = grids.hexes(spark, 4, 4, 4)
    at = spark.range(125).selectExpr("id AS node_id", "(id % 5) / 4D AS x", "(id div 5 % 5) / 4D AS y", "(id div 25) / 4D AS z")
    outside = mesh.faces(hexes).join(mesh.external_faces(hexes).select("elem_id", "face"), ["elem_id", "face"])
    # a face's winding is turned outwards: those of the list that look inwards are 0 and 5 by the corner order
    tri = mesh.split(outside.selectExpr("elem_id * 8 + face AS elem_id", "CASE WHEN face = 0 THEN reverse(nodes) ELSE nodes END AS nodes"), "quad_to_triangle").selectExpr("elem_id * 2 + part AS elem_id", "nodes")
    return _shown(mesh.volume(at, tri), "volume")


@register("a16_counts", f"SELECT count(*) AS elements, count(DISTINCT n0) AS first_nodes FROM {TRIANGLES}")
def a16_counts(spark, sf_dir):
    return triangles(spark, sf_dir).agg(F.count("*").alias("elements"), F.count_distinct(F.col("nodes")[0]).alias("first_nodes"))


@register(
    "a17_most_common",
    "SELECT l_suppkey, l_linenumber AS mode FROM (SELECT l_suppkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first, l_linenumber) AS r "
    "FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)) WHERE r = 1",
)
def a17_most_common(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_linenumber", "l_orderkey * 100 + l_linenumber AS place")
    return mesh.most_common(rows, ["l_suppkey"], "l_linenumber", "place").withColumnRenamed("value", "mode")


@register("a19_tributary_areas", f"""SELECT node_id, round(sum(third), 6) AS area FROM (SELECT unnest(nodes) AS node_id, sqrt(pow(uy * vz - uz * vy, 2) + pow(uz * vx - ux * vz, 2) + pow(ux * vy - uy * vx, 2)) / 6 AS third FROM
    (SELECT t.nodes, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz FROM {TRIANGLES} t JOIN {NODES} p ON p.node_id = n0 JOIN {NODES} q ON q.node_id = n1 JOIN {NODES} r ON r.node_id = n2)) GROUP BY node_id""")
def a19_tributary_areas(spark, sf_dir):
    return mesh.tributary_areas(nodes(spark, sf_dir), triangles(spark, sf_dir)).selectExpr("node_id", "round(area, 6) AS area")


@register("u1_concatenate", f"SELECT count(*) AS elements, sum(n0)::BIGINT AS first_nodes, max(elem_id) AS last FROM (SELECT elem_id, n0 FROM {TRIANGLES} UNION ALL SELECT elem_id + (SELECT max(elem_id) + 1 FROM {TRIANGLES}), n0 + (SELECT max(node_id) + 1 FROM {NODES}) FROM {TRIANGLES})")
def u1_concatenate(spark, sf_dir):
    part = (nodes(spark, sf_dir), triangles(spark, sf_dir))
    return mesh.concatenate([part, part])[1].agg(F.count("*").alias("elements"), F.sum(F.col("nodes")[0]).alias("first_nodes"), F.max("elem_id").alias("last"))


@register("u2_unreferenced", f"SELECT node_id FROM {NODES} WHERE node_id NOT IN (SELECT unnest(nodes) FROM {TRIANGLES})")
def u2_unreferenced(spark, sf_dir):
    return mesh.unreferenced(nodes(spark, sf_dir), triangles(spark, sf_dir)).select("node_id")


@register("u3_duplicate_elements", f"SELECT min(elem_id) AS elem_id FROM {TRIANGLES} GROUP BY list_sort(nodes)")
def u3_duplicate_elements(spark, sf_dir):
    return mesh.drop_duplicates(triangles(spark, sf_dir)).select("elem_id")


@register("u3_duplicate_triangles_ordered", f"SELECT min(elem_id) AS elem_id FROM {TRIANGLES} GROUP BY nodes")
def u3_duplicate_triangles_ordered(spark, sf_dir):
    return mesh.drop_duplicates(triangles(spark, sf_dir), ordered=True).select("elem_id")


@register("u3_u12_duplicate_lines_last", f"SELECT max(elem_id) AS elem_id FROM {TRIANGLES} GROUP BY least(n0, n1), greatest(n0, n1)")
def u3_duplicate_lines(spark, sf_dir):
    lines = triangles(spark, sf_dir).selectExpr("elem_id", "slice(nodes, 1, 2) AS nodes")
    return mesh.drop_duplicates(lines, last=True).select("elem_id")


@register("u4_cancel_opposing", f"""WITH t AS (SELECT elem_id, CASE WHEN n0 <= n1 AND n0 <= n2 THEN [n0, n1, n2] WHEN n1 <= n2 THEN [n1, n2, n0] ELSE [n2, n0, n1] END AS f FROM {TRIANGLES} WHERE n0 != n1 AND n1 != n2 AND n0 != n2),
    w AS (SELECT elem_id, [f[1], least(f[2], f[3]), greatest(f[2], f[3])] AS key, f[2] < f[3] AS way FROM t),
    c AS (SELECT key, sum(CASE WHEN way THEN 1 ELSE 0 END) AS forth, sum(CASE WHEN way THEN 0 ELSE 1 END) AS back FROM w GROUP BY key)
    SELECT elem_id FROM (SELECT w.*, row_number() OVER (PARTITION BY key, way ORDER BY elem_id) AS r FROM w) JOIN c USING (key) WHERE r > least(forth, back)""")
def u4_cancel_opposing(spark, sf_dir):
    return mesh.cancel_opposing(mesh.drop_degenerate(triangles(spark, sf_dir))).select("elem_id")


@register("u5_degenerate", f"SELECT elem_id FROM {TRIANGLES} WHERE n0 != n1 AND n1 != n2 AND n0 != n2")
def u5_degenerate(spark, sf_dir):
    return mesh.drop_degenerate(triangles(spark, sf_dir)).select("elem_id")


@register("u6_odd_edges", f"SELECT least(n0, n1) AS a, greatest(n0, n1) AS b FROM {TRIANGLES} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def u6_odd_edges(spark, sf_dir):
    return mesh.odd_edges(triangles(spark, sf_dir).selectExpr("nodes[0] AS a", "nodes[1] AS b"))


_HEX = "(SELECT id AS e, id % 6 AS ix, id // 6 % 5 AS iy, id // 30 AS iz FROM range(120) t(id))"


@register("u7_external_faces", f"SELECT e AS elem_id, sum(CASE WHEN ix IN (0, 5) THEN 1 ELSE 0 END + CASE WHEN iy IN (0, 4) THEN 1 ELSE 0 END + CASE WHEN iz IN (0, 3) THEN 1 ELSE 0 END)::BIGINT AS faces FROM {_HEX} WHERE ix IN (0, 5) OR iy IN (0, 4) OR iz IN (0, 3) GROUP BY e")
def u7_external_faces(spark, sf_dir):
    return mesh.external_faces(grids.hexes(spark, 6, 5, 4)).groupBy("elem_id").agg(F.count("*").alias("faces"))


@register("u8_interface_nodes", f"SELECT node_id, string_agg(y, ',' ORDER BY y) AS yarns FROM (SELECT DISTINCT unnest(nodes) AS node_id, elem_id % 3 AS y FROM {TRIANGLES}) GROUP BY node_id HAVING count(*) > 1")
def u8_interface_nodes(spark, sf_dir):
    found = mesh.interface_nodes(triangles(spark, sf_dir).withColumn("yarn_id", F.col("elem_id") % 3))
    return found.select("node_id", F.array_join(F.transform("yarns", lambda y: y.cast("string")), ",").alias("yarns"))


@register("u9_u10_common_indices", f"SELECT elem_id, len(list_intersect(list_distinct(nodes), [1, 2, 3, 5, 8])) AS common FROM {TRIANGLES}")
def u9_common_indices(spark, sf_dir):
    return triangles(spark, sf_dir).selectExpr("elem_id", "CAST(size(array_intersect(nodes, array(1L, 2L, 3L, 5L, 8L))) AS BIGINT) AS common")


@register("u11_duplicate_planes", "SELECT nx, ny, d, min(s_suppkey) AS plane_id FROM (SELECT s_suppkey, s_nationkey % 3 AS nx, s_suppkey % 4 AS ny, s_nationkey % 5 AS d FROM supplier) GROUP BY nx, ny, d")
def u11_duplicate_planes(spark, sf_dir):
    planes = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey % 3 AS nx", "s_suppkey % 4 AS ny", "s_nationkey % 5 AS d")
    return planes.groupBy("nx", "ny", "d").agg(F.min("s_suppkey").alias("plane_id"))


@register("u13_columns_to_heddles", "SELECT c_nationkey AS col, n - 1 - (dense_rank() OVER (ORDER BY first) - 1) AS heddle FROM (SELECT c_nationkey, min(c_custkey) AS first, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n FROM customer GROUP BY c_nationkey)")
def u13_columns_to_heddles(spark, sf_dir):
    """Distinct columns by first appearance, numbered from the last. A weave has few; the window is over them alone."""
    from pyspark.sql import Window

    firsts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("col")).agg(F.min("c_custkey").alias("first"))
    n = F.count("*").over(Window.partitionBy())
    return firsts.select("col", (n - F.dense_rank().over(Window.orderBy("first"))).alias("heddle"))


_PAIR = "pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)"


@register("j4_near_pairs", f"SELECT p.node_id AS a, q.node_id AS b FROM {NODES} p, {NODES} q WHERE p.node_id < q.node_id AND {_PAIR} < 0.0009")
def j4_near_pairs(spark, sf_dir):
    at = nodes(spark, sf_dir)
    return mesh.near_pairs(at, at, 0.03).where("a < b").select("a", "b")


@register("j4_merge_nodes", f"""WITH RECURSIVE near AS (SELECT p.node_id AS a, q.node_id AS b FROM {NODES} p, {NODES} q WHERE {_PAIR} < 0.0009),
    walk(a, b) AS (SELECT a, b FROM near UNION SELECT w.a, n.b FROM walk w JOIN near n ON n.a = w.b) SELECT a AS node_id, min(b) AS kept FROM walk GROUP BY a""")
def j4_merge_nodes(spark, sf_dir):
    return mesh.merge_nodes(nodes(spark, sf_dir), 0.03)


@register("j5_translated_pairs", "SELECT id AS a, id + 1 AS b FROM range(125) t(id) WHERE id % 5 < 4")
def j5_translated_pairs(spark, sf_dir):
    at = spark.range(125).selectExpr("id AS node_id", "(id % 5) / 4D AS x", "(id div 5 % 5) / 4D AS y", "(id div 25) / 4D AS z")
    return mesh.translated_pairs(at, (0.25, 0, 0), 1e-3)


@register("j9_nearest", f"SELECT a, b FROM (SELECT p.node_id AS a, q.node_id AS b, row_number() OVER (PARTITION BY p.node_id ORDER BY {_PAIR}, q.node_id) AS r FROM {NODES} p, {NODES} q WHERE p.label != q.label AND p.label < 3 AND q.label >= 3 AND {_PAIR} < 0.0064) WHERE r = 1")
def j9_nearest(spark, sf_dir):
    at = nodes(spark, sf_dir)
    return mesh.nearest(at.where("label < 3"), at.where("label >= 3"), 0.08).select("a", "b")


@register("j14_face_owners", "SELECT id * 8 + f AS face_id, CASE WHEN f = 0 AND id >= 8 THEN id - 8 WHEN f = 5 AND id % 2 = 1 THEN id - 1 WHEN f = 2 AND id // 2 % 4 > 0 THEN id - 2 ELSE id END AS elem_id FROM range(24) t(id), range(6) r(f)")
def j14_face_owners(spark, sf_dir):
    hexes = grids.hexes(spark, 2, 4, 3)
    return mesh.owners_of_faces(mesh.faces(hexes).selectExpr("elem_id * 8 + face AS face_id", "nodes"), hexes)


@register("j15_j20_remap", f"SELECT elem_id, (n0 // 2 * 2) || ',' || (n1 // 2 * 2) || ',' || (n2 // 2 * 2) AS nodes FROM {TRIANGLES}")
def j15_remap(spark, sf_dir):
    mapping = spark.range(16).selectExpr("id AS node_id", "id div 2 * 2 AS kept")
    return mesh.remap(triangles(spark, sf_dir), mapping).select("elem_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


# What each cut gives, part by part, the nodes being numbered from 0: written out, those of two steps too.
_CUTS = {
    "hex_to_wedge": (8, "4 5 6 0 1 2, 6 7 4 2 3 0"),
    "wedge_to_tet_and_pyramid": (6, "3 4 5 2, 0 1 4 3 2"),
    "wedge_to_tet": (6, "3 4 5 2, 1 4 3 2, 3 0 1 2"),
    "hex_to_tet": (8, "0 1 2 6, 5 1 0 6, 0 4 5 6, 2 3 0 4, 7 3 2 4, 2 6 7 4"),
    "hex_to_quad": (8, "3 2 1 0, 0 1 5 4, 1 2 6 5, 2 3 7 6, 3 0 4 7, 4 5 6 7"),
    "wedge_to_surface": (6, "0 1 2, 1 0 3 4, 2 1 4 5, 0 2 5 3, 5 4 3"),
    "pyramid_to_tet": (5, "1 2 3 4, 3 0 1 4"),
    "pyramid_to_surface": (5, "3 2 1 0, 0 1 4, 1 2 4, 2 3 4, 3 0 4"),
    "tet_to_triangle": (4, "2 1 0, 0 1 3, 1 2 3, 2 0 3"),
    "quad_to_triangle": (4, "0 1 2, 0 2 3"),
    "triangle_to_segment": (3, "0 1, 1 2, 2 0"),
}
_IN_ORDER = "array_join(transform(nodes, k -> CAST(k AS STRING)), ' ') AS nodes"
for _name, (_size, _parts) in _CUTS.items():
    _oracle = f"SELECT elem_id, CAST(i - 1 AS INTEGER) AS part, array_to_string(list_transform(string_split(p, ' '), lambda k: CAST(elem_id + CAST(k AS BIGINT) AS VARCHAR)), ' ') AS nodes FROM (SELECT s_suppkey * {_size} AS elem_id, unnest(string_split('{_parts}', ', ')) AS p, generate_subscripts(string_split('{_parts}', ', '), 1) AS i FROM supplier)"

    @register(f"i16_{_name}", _oracle)
    def _query(spark, sf_dir, name=_name, size=_size):
        """Each element's parts, with their nodes in order."""
        elements = table(spark, sf_dir, "supplier").selectExpr(f"s_suppkey * {size} AS elem_id", f"transform(sequence(0, {size - 1}), k -> s_suppkey * {size} + k) AS nodes")
        return mesh.split(elements, name).selectExpr("elem_id", "part", _IN_ORDER)


@register(
    "i16_quads_by_shorter_diagonal",
    f"""SELECT q.elem_id, CAST(i - 1 AS INTEGER) AS part, CASE WHEN far02 < far13 THEN CASE i WHEN 1 THEN concat_ws(' ', n, n + 1, n + 2) ELSE concat_ws(' ', n, n + 2, n + 3) END
        ELSE CASE i WHEN 1 THEN concat_ws(' ', n + 1, n + 2, n + 3) ELSE concat_ws(' ', n + 3, n, n + 1) END END AS nodes
    FROM (SELECT a.node_id AS elem_id, a.node_id AS n, pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2) AS far02, pow(b.x - d.x, 2) + pow(b.y - d.y, 2) + pow(b.z - d.z, 2) AS far13
        FROM {NODES} a JOIN {NODES} b ON b.node_id = a.node_id + 1 JOIN {NODES} c ON c.node_id = a.node_id + 2 JOIN {NODES} d ON d.node_id = a.node_id + 3) q, range(1, 3) r(i)""",
)
def i16_quads_by_shorter_diagonal(spark, sf_dir):
    at = nodes(spark, sf_dir)
    last = at.select((F.col("node_id") - 3).alias("elem_id"))
    quads = at.select(F.col("node_id").alias("elem_id")).join(last, "elem_id").selectExpr("elem_id", "array(elem_id, elem_id + 1, elem_id + 2, elem_id + 3) AS nodes")
    return mesh.split(quads, "quad_to_triangle", at.select("node_id", "x", "y", "z")).selectExpr("elem_id", "part", _IN_ORDER)


@register("i8_smooth", f"WITH e AS (SELECT DISTINCT least(n0, n1) AS a, greatest(n0, n1) AS b FROM {TRIANGLES} WHERE n0 != n1), o AS (SELECT a, b FROM e UNION SELECT b, a FROM e), m AS (SELECT o.a, avg(x) AS mx FROM o JOIN {NODES} n ON n.node_id = o.b GROUP BY o.a) SELECT node_id, round(x + 0.5 * (coalesce(mx, x) - x), 7) AS x FROM {NODES} LEFT JOIN m ON m.a = node_id")
def i8_smooth(spark, sf_dir):
    edges = triangles(spark, sf_dir).selectExpr("nodes[0] AS a", "nodes[1] AS b").where("a != b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return mesh.smooth(nodes(spark, sf_dir), edges, 0.5).selectExpr("node_id", "round(x, 7) AS x")


@register("a15_inverted_elements", f"SELECT count(*) AS inverted FROM {NODES} a JOIN {NODES} b ON b.node_id = a.node_id + 1 JOIN {NODES} c ON c.node_id = a.node_id + 2 JOIN {NODES} d ON d.node_id = a.node_id + 3 WHERE ((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)) * (d.x - a.x) + ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) * (d.y - a.y) + ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) * (d.z - a.z) < 0")
def a15_inverted_elements(spark, sf_dir):
    """Tetrahedra of four successive nodes with negative volume."""
    from loomspark.functions import vec

    at = nodes(spark, sf_dir)
    placed = at.select(F.explode(F.expr("sequence(0, 3)")).alias("k"), "*").selectExpr("node_id - k AS elem_id", "k", "x", "y", "z")
    tets = placed.groupBy("elem_id").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{p}{c}") for k, p in enumerate("amcd") for c in "xyz")).where("n = 4")
    return tets.agg(F.expr(f"count_if({vec.tet_volume(*(vec.vec(p) for p in 'amcd'))} < 0)").alias("inverted"))
