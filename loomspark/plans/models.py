"""Queries over paths, measures, weaves, materials and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import yarns
from loomspark.plans.registry import register
from loomspark.session import table
from loomspark.sources import decks, grids

#: A polyline for each order: a node for each line number.
PATH = "(SELECT l_orderkey AS yarn_id, l_linenumber AS node_idx, min(l_quantity) AS x, min(l_discount) * 100 AS y, min(l_tax) * 100 AS z FROM lineitem GROUP BY 1, 2)"
_STEP = f"(SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS step FROM {PATH} WINDOW w AS (PARTITION BY yarn_id ORDER BY node_idx))"


def paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("yarn_id"), F.col("l_linenumber").alias("node_idx"))
    return rows.agg(F.min("l_quantity").alias("x"), (F.min("l_discount") * 100).alias("y"), (F.min("l_tax") * 100).alias("z"))


@register("a5_yarn_length", f"SELECT yarn_id, round(sum(step), 6) AS length, count(*) AS nodes FROM {_STEP} GROUP BY yarn_id")
def a5_yarn_length(spark, sf_dir):
    return yarns.steps(paths(spark, sf_dir)).groupBy("yarn_id").agg(F.round(F.sum("step"), 6).alias("length"), F.count("*").alias("nodes"))


@register("w1_tangents", f"SELECT yarn_id, node_idx, round(dx / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0), 7) AS tx, round(dz / nullif(sqrt(dx * dx + dy * dy + dz * dz), 0), 7) AS tz FROM (SELECT yarn_id, node_idx, " + ", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS d{c}" for c in "xyz") + f" FROM {PATH} WINDOW w AS (PARTITION BY yarn_id ORDER BY node_idx))")
def w1_tangents(spark, sf_dir):
    return yarns.tangents(paths(spark, sf_dir)).selectExpr("yarn_id", "node_idx", "round(tx, 7) AS tx", "round(tz, 7) AS tz")


@register("w2_arc_length", f"SELECT yarn_id, node_idx, round(sum(step) OVER (PARTITION BY yarn_id ORDER BY node_idx), 6) AS arc FROM {_STEP}")
def w2_arc_length(spark, sf_dir):
    return yarns.steps(paths(spark, sf_dir)).selectExpr("yarn_id", "node_idx", "round(arc, 6) AS arc")


@register("w2_resample", f"""WITH a AS (SELECT *, sum(step) OVER (PARTITION BY yarn_id ORDER BY node_idx) AS arc FROM {_STEP}), b AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(arc) OVER w AS arc2, max(arc) OVER (PARTITION BY yarn_id) AS total FROM a WINDOW w AS (PARTITION BY yarn_id ORDER BY node_idx))
    SELECT yarn_id, CAST(j AS INT) AS j, round(x + (x2 - x) * (j * total / 8 - arc) / (arc2 - arc), 5) AS x, round(z + (z2 - z) * (j * total / 8 - arc) / (arc2 - arc), 5) AS z FROM b, range(9) r(j) WHERE arc2 > arc AND j * total / 8 >= arc AND (j * total / 8 < arc2 OR (j = 8 AND arc2 = total))""")
def w2_resample(spark, sf_dir):
    return yarns.resample(paths(spark, sf_dir), 9).selectExpr("yarn_id", "j", "round(x, 5) AS x", "round(z, 5) AS z")


@register("o7_closest_reed", "SELECT p_partkey, reed FROM (SELECT p_partkey, reed, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - reed), reed) AS r FROM part CROSS JOIN (VALUES (5), (12), (20), (31), (44)) v(reed)) WHERE r = 1")
def o7_closest_reed(spark, sf_dir):
    """The nearest of a few reeds; the smaller of two as near. The reeds are in the expression, so nothing is joined."""
    nearest = "array_min(transform(array(5, 12, 20, 31, 44), r -> named_struct('d', abs(p_size - r), 'reed', r))).reed"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{nearest} AS reed")




@register("f49_units", "SELECT p_partkey, round(p_size * f, 12) AS metres FROM part JOIN (VALUES (0, 1.0::DOUBLE), (1, 0.001::DOUBLE), (2, 0.000001::DOUBLE)) v(k, f) ON k = p_partkey % 3")
def f49_units(spark, sf_dir):
    """Lengths in m, mm and um as metres."""
    from loomspark.functions.units import convert

    unit = F.expr("element_at(array('m', 'mm', 'um'), CAST(p_partkey % 3 + 1 AS INT))")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(convert(F.col("p_size").cast("double"), unit, "m"), 12).alias("metres"))


@register("f50_stringify", "SELECT p_partkey, printf('%.12e', CAST(p_size AS DOUBLE)) AS shown FROM part")
def f50_stringify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.12e", F.col("p_size").cast("double")).alias("shown"))


@register("f54_common_denominator", "SELECT p_partkey, gcd(CAST(p_size AS BIGINT) * 12, CAST(p_partkey AS BIGINT) * 18) / 100.0::DOUBLE AS d FROM part")
def f54_common_denominator(spark, sf_dir):
    """Of two lengths that are multiples of a hundredth, by Euclid's steps in a fold."""
    fold = "aggregate(sequence(1, 64), named_struct('a', p_size * 12L, 'b', p_partkey * 18L), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a / 100D)"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{fold} AS d")


@register("a9_materials", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN 'Mat0' ELSE 'Mat' || r END AS material FROM part JOIN (SELECT a, b, row_number() OVER (PARTITION BY a = 0 AND b = 0 ORDER BY first) AS r FROM (SELECT p_size % 4 AS a, p_partkey % 3 AS b, min(p_partkey) AS first FROM part GROUP BY 1, 2)) ON a = p_size % 4 AND b = p_partkey % 3")
def a9_materials(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 4 AS e", "p_partkey % 3 AS nu")
    return yarns.distinct_materials(rows, "p_partkey", ["e", "nu"])


@register("a22_tolerance_unique")
def a22_tolerance_unique(spark, sf_dir):
    """Levels of each group that stand above the last kept one by more than the tolerance: a fold, as each step needs the one before."""
    fold = "aggregate(levels, CAST(array() AS array<double>), (kept, v) -> CASE WHEN size(kept) = 0 OR v > kept[size(kept) - 1] + 500 THEN concat(kept, array(v)) ELSE kept END)"
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_acctbal")).alias("levels"))
    return rows.select("s_nationkey", F.posexplode(F.expr(fold)).alias("k", "level"))


_SWAPPED = ((0, 0), (1, 1))


@register("g1_g2_weave", "SELECT CAST(yarn AS INT) AS yarn_id, CAST(n AS INT) AS node_idx, CASE WHEN yarn < 2 THEN yarn ELSE n END::DOUBLE AS x, CASE WHEN yarn < 2 THEN n ELSE yarn - 2 END::DOUBLE AS y, CASE WHEN (yarn + n) % 2 = 0 THEN CASE WHEN yarn < 2 THEN -0.05 ELSE 0.05 END ELSE CASE WHEN yarn < 2 THEN 0.05 ELSE -0.05 END END::DOUBLE AS z FROM range(4) a(yarn), range(3) b(n)")
def g1_weave(spark, sf_dir):
    return yarns.weave(spark, 2, 2, 1.0, 0.2, _SWAPPED)


@register("g10_default_domain", "SELECT -0.5::DOUBLE AS lo_x, 1.5::DOUBLE AS hi_x, -0.1::DOUBLE AS lo_z, 0.1::DOUBLE AS hi_z")
def g10_default_domain(spark, sf_dir):
    """Half a spacing round the first repeat; as high as the weave is thick."""
    nodes = yarns.weave(spark, 2, 2, 1.0, 0.2, _SWAPPED)
    return nodes.selectExpr("x", "z", "node_idx").agg(F.expr("min(x) - 0.5D").alias("lo_x"), F.expr("max(x) - 0.5D").alias("hi_x"), F.expr("min(z) - 0.05D").alias("lo_z"), F.expr("max(z) + 0.05D").alias("hi_z"))


@register("j21_periodic_images", "SELECT CAST(y AS INT) AS yarn_id, i::DOUBLE * 2 AS dx, j::DOUBLE * 3 AS dy FROM range(4) a(y), range(-1, 2) b(i), range(-1, 2) c(j)")
def j21_periodic_images(spark, sf_dir):
    return yarns.periodic_images(spark.range(4).selectExpr("CAST(id AS INT) AS yarn_id"), [(2, 0, 0), (0, 3, 0)]).select("yarn_id", "dx", "dy")


@register("i2_spline_coefficients", None)
def i2_spline_coefficients(spark, sf_dir):
    return yarns.spline(paths(spark, sf_dir)).selectExpr("yarn_id", "node_idx", "round(mx, 6) AS mx", "round(my, 6) AS my", "round(mz, 6) AS mz")


@register("k1_set_lines", "SELECT set_name, CAST((r - 1) // 16 AS INT) AS line, string_agg(elem_id, ', ' ORDER BY elem_id) AS value FROM (SELECT 'Set' || (l_suppkey % 3) AS set_name, l_orderkey AS elem_id, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey) AS r FROM (SELECT DISTINCT l_suppkey % 3 AS l_suppkey, l_orderkey FROM lineitem)) GROUP BY 1, 2")
def k1_set_lines(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").selectExpr("concat('Set', l_suppkey % 3) AS set_name", "l_orderkey AS elem_id").distinct()
    return decks.set_lines(sets)


@register("s5_k1_deck_round_trip", "SELECT id AS elem_id, (id % 3) + (id // 3 % 3) * 4 + (id // 9) * 16 AS first_node, round((id % 3) / 3.0, 9) AS x, 'set' || (id % 2) AS set_name FROM range(27) t(id)")
def s5_deck_round_trip(spark, sf_dir):
    """A deck of 27 elements as text and back: elements with their first node, its x, and their set."""
    nodes = spark.range(64).selectExpr("id AS node_id", "(id % 4) / 3D AS x", "(id div 4 % 4) / 3D AS y", "(id div 16) / 3D AS z")
    hexes = grids.hexes(spark, 3, 3, 3)
    lines = decks.deck_lines(nodes, hexes, hexes.selectExpr("concat('Set', elem_id % 2) AS set_name", "elem_id")).withColumn("file", F.lit("deck"))
    n, e, s = decks.parse_deck(lines)
    found = e.selectExpr("elem_id", "nodes[0] AS first_node").join(n, F.col("first_node") == n.node_id).join(s, "elem_id")
    return found.selectExpr("elem_id", "first_node", "round(x, 9) AS x", "set_name")


@register("s6_displacements", "SELECT p_partkey AS node_id, round(p_size / 7.0, 5) AS u1, -0.5::DOUBLE AS u2 FROM part")
def s6_displacements(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.format_string("   %d   %.9e  -0.5   1.0E-3", "p_partkey", F.col("p_size") / 7.0).alias("value"))
    head = spark.createDataFrame([(-3, "  SOME TITLE 12"), (-2, "   NODE  U1  U2  U3"), (-1, " NOTE")], "line_no long, value string")
    lines = head.unionByName(rows).withColumn("file", F.lit("table"))
    return decks.parse_displacements(lines).selectExpr("node_id", "round(u1, 5) AS u1", "u2")


@register("i23_boundary_sets", "SELECT n AS on_faces, count(*) AS nodes FROM (SELECT CASE WHEN id % 5 IN (0, 4) THEN 1 ELSE 0 END + CASE WHEN id // 5 % 5 IN (0, 4) THEN 1 ELSE 0 END + CASE WHEN id // 25 IN (0, 4) THEN 1 ELSE 0 END AS n FROM range(125) t(id)) GROUP BY n")
def i23_boundary_sets(spark, sf_dir):
    """Nodes of a periodic cell by the number of faces they lie on: inside, faces, edges, vertices."""
    nodes = grids.corners(spark, (5, 5, 5))
    on = sum((F.col(c).isin(0, 4).cast("int") for c in ("ix", "iy", "iz")), F.lit(0))
    return nodes.select(on.alias("on_faces")).groupBy("on_faces").agg(F.count("*").alias("nodes"))


@register("i17_yarn_surface", "SELECT CAST(16 * 15 * 8 AS BIGINT) AS quads, CAST(16 * 16 * 8 AS BIGINT) AS nodes")
def i17_yarn_surface(spark, sf_dir):
    """Quads between successive sections of eight points of the straight-yarn grid."""
    from loomspark.sources.fixtures import yarn_grid

    rows = yarn_grid(spark).select("yarn_id", F.posexplode("nodes").alias("i", "n"))
    ring = rows.select("yarn_id", "i", F.explode(F.expr("sequence(0, 7)")).alias("k")).withColumn("node_id", F.expr("(yarn_id * 16 + i) * 8 + k"))
    here, there = ring.alias("a"), ring.selectExpr("yarn_id", "i - 1 AS i", "k", "node_id AS other")
    quads = here.join(there, ["yarn_id", "i", "k"]).selectExpr("array(node_id, (yarn_id * 16 + i) * 8 + (k + 1) % 8, (yarn_id * 16 + i + 1) * 8 + (k + 1) % 8, other) AS nodes")
    return quads.agg(F.count("*").alias("quads")).crossJoin(quads.select(F.explode("nodes").alias("n")).agg(F.count_distinct("n").alias("nodes")))
