"""Queries over the measures, choices and rules of ``operators.measures``.

The driver's tables stand for yarns, sections, cells and planes; the SQL is written from the definitions, with joins
and correlated subqueries where the operators use windows, arrays or structs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import vec
from loomspark.operators import exact, measures
from loomspark.plans.models import PATH, paths
from loomspark.plans.registry import register
from loomspark.plans.scalars import EDGES, POINTS, points
from loomspark.plans.spatial import _MOVED
from loomspark.session import table
from loomspark.sources import fixtures, grids, parameters


def _rounded(*names: str, digits: int = 6) -> list[str]:
    return [f"round({n}, {digits}) AS {n}" for n in names]


# Along a yarn and up a cell


@register("w8_a21_mid_points", f"SELECT a.yarn_id, a.node_idx, round((a.x + (SELECT arg_max(b.x, b.node_idx) FROM {PATH} b WHERE b.yarn_id = a.yarn_id AND b.node_idx < a.node_idx)) / 2, 6) AS mid FROM {PATH} a")
def w8_mid_points(spark, sf_dir):
    return measures.mid_values(paths(spark, sf_dir), "yarn_id", "node_idx", "x").selectExpr("yarn_id", "node_idx", "round(mid, 6) AS mid")


_LEVELS = "(SELECT l_suppkey, l_linenumber, avg(l_quantity) AS h FROM lineitem GROUP BY 1, 2)"


@register("w5_stack_heights", f"SELECT a.l_suppkey, a.l_linenumber, round(sum(b.h) - a.h, 6) AS bottom, round(sum(b.h), 6) AS top FROM {_LEVELS} a JOIN {_LEVELS} b ON b.l_suppkey = a.l_suppkey AND b.l_linenumber <= a.l_linenumber GROUP BY a.l_suppkey, a.l_linenumber, a.h")
def w5_stack_heights(spark, sf_dir):
    levels = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("h"))
    return measures.stacked(levels, "l_suppkey", "l_linenumber", "h").selectExpr("l_suppkey", "l_linenumber", *_rounded("bottom", "top"))


@register(
    "w4_bracketing_sections",
    """WITH p AS (SELECT DISTINCT l_orderkey AS yarn_id, l_quantity / 51 AS u FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY yarn_id ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY yarn_id) AS n, (yarn_id % 97) / 97.0::DOUBLE AS t FROM p),
    m AS (SELECT yarn_id, t, n, max(i) FILTER (WHERE u <= t) AS lo, min(i) FILTER (WHERE u >= t) AS hi, max(u) FILTER (WHERE u <= t) AS lu, min(u) FILTER (WHERE u >= t) AS hu, min(u) AS first, max(u) AS last FROM s GROUP BY yarn_id, t, n),
    w AS (SELECT yarn_id, t, coalesce(lo, n - 1) AS below, coalesce(hi, 0) AS above, coalesce(lu, last - 1) AS a, coalesce(hu, first + 1) AS b FROM m)
    SELECT yarn_id, CAST(below AS INTEGER) AS below, CAST(above AS INTEGER) AS above, round(CASE WHEN a = b THEN 0 ELSE (t - a) / (b - a) END, 7) AS share FROM w""",
)
def w4_bracketing_sections(spark, sf_dir):
    """Sections of each yarn at its nodes' places; the yarn repeats."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("yarn_id")).agg(F.array_sort(F.collect_set(F.expr("l_quantity / 51"))).alias("places")).withColumn("t", F.expr("(yarn_id % 97) / 97.0D"))
    return rows.withColumns(measures.bracketing("places", "t")).selectExpr("yarn_id", "below", "above", "round(share, 7) AS share")


_ENDS = "(SELECT l_orderkey AS yarn_id, arg_min(l_quantity, l_linenumber) AS a, arg_max(l_quantity, l_linenumber) AS b FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1)"


@register("p12_repeat_is_end_to_end", f"SELECT yarn_id, abs(b - a) = yarn_id % 5 * 7 AS matches FROM {_ENDS} JOIN orders ON o_orderkey = yarn_id")
def p12_ends_match(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("yarn_id"), F.col("l_linenumber").alias("node_idx")).agg(F.min("l_quantity").alias("x")).selectExpr("*", "0D AS y", "0D AS z")
    repeats = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS yarn_id", "CAST(o_orderkey % 5 * 7 AS DOUBLE) AS rx", "0D AS ry", "0D AS rz")
    return measures.ends_match(nodes, repeats)


# Sums over a textile: suppliers are yarns of their nation's textile

_YARNS = "(SELECT s_suppkey AS yarn_id, s_nationkey AS textile_id, abs(s_acctbal) AS len, s_suppkey % 9 + 1.0 AS sect, CASE WHEN s_suppkey % 5 = 0 THEN n_nationkey + 0.5 ELSE s_suppkey % 5 / 10.0 END AS fib, s_suppkey % 41 AS rep FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def _yarns(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS yarn_id", "s_nationkey AS textile_id", "abs(s_acctbal) AS length", "s_suppkey % 9 + 1.0D AS section_area", "s_suppkey % 5 / 10.0D AS fibre_area", "CAST(s_suppkey % 41 AS DOUBLE) AS repeat_area")
    textiles = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS textile_id", "n_nationkey + 0.5D AS fibre_area")
    return measures.with_fallback(rows, textiles, "textile_id", ["fibre_area"])


@register("a7_yarn_properties", f"SELECT yarn_id, round(len * sect, 6) AS volume, round(fib * len, 6) AS fibre_volume, round(fib / sect, 6) AS fraction, round(CASE WHEN rep > 0 THEN len / rep END, 6) AS length_per_area FROM {_YARNS}")
def a7_yarn_properties(spark, sf_dir):
    return measures.yarn_properties(_yarns(spark, sf_dir)).selectExpr("yarn_id", *_rounded("volume", "fibre_volume", "fraction", "length_per_area"))


@register(
    "a6_textile_totals",
    f"SELECT textile_id, round(sum(len), 4) AS length, round(sum(len * sect), 4) AS volume, round(sum(len * fib), 4) AS fibre_volume, round(CASE WHEN bool_or(rep = 0) THEN 0 ELSE sum(len / rep) END, 4) AS length_per_area, round(CASE WHEN bool_or(rep = 0) THEN 0 ELSE sum(len * fib / rep) END, 4) AS fibre_volume_per_area FROM {_YARNS} GROUP BY textile_id",
)
def a6_textile_totals(spark, sf_dir):
    return measures.textile_totals(_yarns(spark, sf_dir)).selectExpr("textile_id", *_rounded("length", "volume", "fibre_volume", "length_per_area", "fibre_volume_per_area", digits=4))


@register("a8_volume_fraction", f"SELECT textile_id, round((SELECT sum(y.len * y.fib) FROM {_YARNS} y WHERE y.textile_id = t.textile_id) / (1e6 + textile_id), 9) AS fraction FROM (SELECT DISTINCT textile_id FROM {_YARNS}) t")
def a8_volume_fraction(spark, sf_dir):
    domains = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS textile_id", "1e6D + n_nationkey AS volume")
    return measures.domain_fraction(measures.yarn_properties(_yarns(spark, sf_dir)), domains).selectExpr("textile_id", "round(fraction, 9) AS fraction")


_STRAIN = {"e11": "l_quantity", "e22": "l_discount", "e33": "l_tax", "e12": "l_extendedprice", "e13": "l_quantity + l_tax", "e23": "l_partkey"}


def _mean(load: int, c: str) -> str:
    return f"(SELECT avg({_STRAIN[c]}) FROM lineitem i WHERE i.l_suppkey = m.l_suppkey AND i.l_linenumber = {load})"


@register(
    "a12_homogenised_constants",
    f"SELECT l_suppkey AS model_id, round(1 / {_mean(1, 'e11')}, 7) AS E1, round(1 / {_mean(3, 'e33')}, 5) AS E3, round(-{_mean(1, 'e22')} / {_mean(1, 'e11')}, 7) AS nu12, round(-{_mean(2, 'e33')} / {_mean(2, 'e22')}, 7) AS nu23, round(1 / {_mean(4, 'e12')}, 9) AS G12, round(1 / {_mean(6, 'e23')}, 7) AS G23 FROM (SELECT DISTINCT l_suppkey FROM lineitem) m",
)
def a12_constants(spark, sf_dir):
    """Line numbers 1 to 6 are load cases, means over a supplier's lines the strains."""
    strains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model_id"), F.col("l_linenumber").alias("load")).agg(*(F.expr(f"avg({e})").alias(c) for c, e in _STRAIN.items()))
    return measures.constants(strains).selectExpr("model_id", *_rounded("E1", digits=7), *_rounded("E3", digits=5), *_rounded("nu12", "nu23", digits=7), *_rounded("G12", digits=9), *_rounded("G23", digits=7))


@register(
    "a18_yarn_widths",
    "SELECT p_brand AS textile_id, round(sum(p_size) / count(*), 6) AS mean, max(p_size) AS widest, (SELECT max(n) FROM (SELECT count(*) AS n FROM part q WHERE q.p_brand = p.p_brand GROUP BY q.p_partkey % 3, q.p_partkey % 4)) AS layers FROM part p GROUP BY p_brand",
)
def a18_yarn_widths(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_brand AS textile_id", "p_size AS width", "p_partkey % 3 AS x", "p_partkey % 4 AS y")
    return measures.widths(parts, parts).selectExpr("textile_id", "round(mean, 6) AS mean", "widest", "layers")


@register("a23_benchmark_summary", "SELECT event_type, count(value) AS runs, min(value) AS fastest, round(sum(value) / count(value), 6) AS mean, max(value) AS slowest, round(count(value) / sum(value), 9) AS a_second FROM events GROUP BY event_type")
def a23_summary(spark, sf_dir):
    return measures.run_summary(table(spark, sf_dir, "events"), "event_type", "value").selectExpr("event_type", "runs", "fastest", "round(mean, 6) AS mean", "slowest", "round(a_second, 9) AS a_second")


# Choices


@register("o2_sorted_by_height", "SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_acctbal, s_suppkey) AS ids FROM supplier GROUP BY s_nationkey")
def o2_in_order(spark, sf_dir):
    rows = measures.in_order(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey")
    return rows.select("s_nationkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@register("o5_arg_min", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def o5_arg_min(spark, sf_dir):
    return measures.least(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_orderkey", "l_linenumber")


@register("u15_contact_pairs", "SELECT a, b FROM (SELECT l_partkey % 20 AS a, l_suppkey % 20 AS b FROM lineitem UNION SELECT l_suppkey % 20, l_partkey % 20 FROM lineitem) WHERE a < b")
def u15_contact_pairs(spark, sf_dir):
    return measures.contact_pairs(table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 20 AS p", "l_suppkey % 20 AS s"), "p", "s")


_CELLS = "(SELECT l_orderkey AS textile_id, l_linenumber % 2 AS x, l_linenumber // 2 % 2 AS y, CASE WHEN l_partkey % 3 = 0 THEN 'X' ELSE 'Y' END AS kind FROM lineitem)"


@register(
    "p11_pattern_validity",
    f"WITH c AS (SELECT textile_id, x, y, sum(CASE WHEN kind = 'X' THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN kind = 'Y' THEN 1 ELSE 0 END) AS ny FROM {_CELLS} GROUP BY ALL) SELECT textile_id, NOT EXISTS (SELECT 1 FROM c a JOIN c b USING (textile_id) WHERE a.textile_id = t.textile_id AND ((a.y = b.y AND a.nx != b.nx) OR (a.x = b.x AND a.ny != b.ny))) AS valid FROM (SELECT DISTINCT textile_id FROM c) t",
)
def p11_valid_patterns(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS textile_id", "l_linenumber % 2 AS x", "l_linenumber div 2 % 2 AS y", "CASE WHEN l_partkey % 3 = 0 THEN 'X' ELSE 'Y' END AS kind")
    return measures.valid_patterns(cells)


_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'TET' WHEN 1 THEN 'HEX' WHEN 2 THEN 'WEDGE' ELSE 'QUAD' END"
_SET = "concat(CASE p_partkey % 3 WHEN 0 THEN 'Yarn' WHEN 1 THEN 'YARN_' ELSE 'Matrix' END, CAST(p_size AS STRING))"


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(f"{_SET} AS set_name", "p_partkey AS elem_id", f"{_TYPE} AS type")


@register("p15_kept_types", "SELECT p_partkey AS elem_id FROM part WHERE p_partkey % 4 IN (0, 1)")
def p15_kept_types(spark, sf_dir):
    return measures.of_types(_sets(spark, sf_dir), "TET", "HEX").select("elem_id")


@register("p15_dropped_types", "SELECT p_partkey AS elem_id FROM part WHERE p_partkey % 4 NOT IN (0, 1)")
def p15_dropped_types(spark, sf_dir):
    return measures.of_types(_sets(spark, sf_dir), "TET", "HEX", keep=False).select("elem_id")


@register("p16_sets_auto", "SELECT p_partkey AS elem_id FROM part WHERE p_partkey % 3 < 2")
def p16_sets_auto(spark, sf_dir):
    return measures.set_members(_sets(spark, sf_dir), "auto")


@register("p16_sets_by_name", "SELECT p_partkey AS elem_id, true AS is_exact FROM part WHERE p_partkey % 3 = 1 AND p_size = 7 UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey % 3 = 0 AND left(p_size::VARCHAR, 1) = '1'")
def p16_sets_by_name(spark, sf_dir):
    """One name that a set has, and a part of names: ``YARN_7`` is also within the names of others."""
    rows = _sets(spark, sf_dir)
    return measures.set_members(rows, "YARN_7").withColumn("is_exact", F.lit(True)).unionAll(measures.set_members(rows, "arn1").withColumn("is_exact", F.lit(False)))


@register("p13_boundary_cells", "SELECT l_orderkey, l_linenumber, l_quantity IN (1, 50) OR round(l_discount * 100) IN (0, 10) OR round(l_tax * 100) IN (0, 8) AS is_boundary FROM lineitem")
def p13_on_boundary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_quantity - 1) / 49 AS x", "l_discount / 0.1D AS y", "l_tax / 0.08D AS z")
    return rows.select("l_orderkey", "l_linenumber", measures.on_boundary(("x", "y", "z"), ("0", "0", "0"), ("1", "1", "1")).alias("is_boundary"))


# Domains: a box for each nation, of which every fifth has a plane aslant; a seventh plane touches nothing

_BOX = "(SELECT n_nationkey AS domain_id, CAST(-1 - n_nationkey AS DOUBLE) AS lo, CAST(2 + n_nationkey AS DOUBLE) AS hi FROM nation)"


def _planes(spark, sf_dir, seventh: bool = False):
    aslant = "CASE WHEN domain_id % 5 = 0 THEN 0.6D ELSE 1D END"
    rows = ["(0, 1D, 0D, 0D, lo)", "(1, -1D, 0D, 0D, -hi)", f"(2, 0D, {aslant}, CASE WHEN domain_id % 5 = 0 THEN 0.8D ELSE 0D END, lo)", "(3, 0D, -1D, 0D, -hi)", "(4, 0D, 0D, 1D, lo / 2)", "(5, 0D, 0D, -1D, -hi / 2)"]
    rows += ["(6, 0.6D, 0.8D, 0D, lo * 4)"] if seventh else []
    names = ("plane_id", "nx", "ny", "nz", "d")
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, r[1:-1].split(", "), strict=True)) + ")" for r in rows)
    boxes = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS domain_id", "-1D - n_nationkey AS lo", "2D + n_nationkey AS hi")
    return boxes.select("domain_id", F.explode(F.expr(f"array({structs})")).alias("p")).select("domain_id", "p.*")


@register("f53_box_limits", f"SELECT domain_id, lo AS lox, hi AS hix, lo AS loy, hi AS hiy, lo / 2 AS loz, hi / 2 AS hiz FROM {_BOX} WHERE domain_id % 5 != 0")
def f53_box_limits(spark, sf_dir):
    return measures.box_limits(_planes(spark, sf_dir))


@register(
    "g13_hull_nodes",
    f"SELECT domain_id, x, round(y, 6) AS y, z FROM (SELECT domain_id, x, CASE WHEN low AND domain_id % 5 = 0 THEN (lo - 0.8 * z) / 0.6 WHEN low THEN lo ELSE hi END AS y, z FROM (SELECT *, unnest([lo, hi]) AS x FROM {_BOX}) JOIN (SELECT domain_id, unnest([lo / 2, hi / 2]) AS z FROM {_BOX}) USING (domain_id), (VALUES (true), (false)) v(low))",
)
def g13_hull_nodes(spark, sf_dir):
    """Corners of boxes, some with a side aslant; the seventh plane cuts nothing off."""
    return measures.hull_nodes(_planes(spark, sf_dir, seventh=True)).selectExpr("domain_id", "x + 0D AS x", "round(y, 6) AS y", "z + 0D AS z")


@register(
    "p8_meshes_meet_domain",
    f"SELECT label, NOT (max(x) < -0.9 OR min(x) > 0.1 OR max(y) < -0.1 OR min(y) > 0.05 OR max(z) < 0 OR min(z) > 1) AS meets FROM (SELECT (vec_id % 50) AS label, a[1] AS x, a[2] AS y, a[3] AS z FROM {POINTS}) GROUP BY label",
)
def p8_meets_box(spark, sf_dir):
    nodes = points(spark, sf_dir).selectExpr("vec_id % 50 AS label", "ax AS x", "ay AS y", "az AS z")
    return measures.meets_box(nodes, "label", (-0.9, -0.1, 0.0), (0.1, 0.05, 1.0))


@register("p10_octree_overlap", f"SELECT vec_id, len(list_filter([1, 2, 3], lambda i: a[i] < -0.05 - 0.01 OR a[i] > 0.1 + 0.01)) = 0 AS is_in FROM {POINTS}")
def p10_overlap(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", F.expr(measures.overlaps_cell(("ax", "ay", "az"), "0.01D", ("-0.05D",) * 3, ("0.1D",) * 3)).alias("is_in"))


# Rules of one value


@register("f18_palette", "SELECT p_partkey, c[1] AS r, c[2] AS g, c[3] AS b FROM part JOIN (SELECT unnest(range(10)) AS k, unnest([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 1, 1], [1, 0, 1], [1, 0, 0.5], [0, 0.5, 1], [1, 0.5, 0], [0.5, 1, 0]]::DOUBLE[][]) AS c) ON k = p_partkey % 10")
def f18_palette(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", measures.colour("p_partkey").alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@register(
    "f45_fibre_area",
    "SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN pi() * pow(p_retailprice / 2000, 2) * p_size WHEN 2 THEN p_size / p_retailprice ELSE 0 END, 6) AS area FROM part",
)
def f45_fibre_area(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 4 = 0 THEN p_retailprice WHEN p_size % 4 = 1 THEN 0D END AS area", "CASE WHEN p_size % 4 < 2 THEN p_size END AS n", "p_retailprice / 1000 AS diameter", "CASE WHEN p_size % 4 < 3 THEN p_size END AS linear", "p_retailprice AS density")
    return rows.select("p_partkey", F.round(measures.fibre_area("area", "n", "diameter", "linear", "density"), 6).alias("area"))


@register("f44_volume_fraction", "SELECT p_partkey, round(10 * p_size / p_retailprice, 9) AS value, 10 * p_size > 0.86 * p_retailprice AS is_suspect FROM part")
def f44_fraction(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS fibre", "p_retailprice / 10 AS section")
    return rows.select("p_partkey", measures.fraction("fibre", "section").alias("f")).selectExpr("p_partkey", "round(f.value, 9) AS value", "f.suspect AS is_suspect")


@register(
    "f44_quadratic_fraction",
    f"SELECT vec_id, round(0.02 / abs(area - 0.4 * second / pow(widest, 2)) * (1 - 0.4 * pow(px / widest, 2)), 6) AS value FROM (SELECT vec_id, any_value(px) AS px, max(abs(x1)) AS widest, sum(x1 * y2 - x2 * y1) / 2 AS area, sum((x1 * y2 - x2 * y1) * (x1 * x1 + x1 * x2 + x2 * x2)) / 12 AS second FROM {EDGES} GROUP BY vec_id)",
)
def f44_quadratic(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", F.round(measures.fraction_at("0.02D", "ring", "0.6D", "px"), 6).alias("value"))


@register(
    "f41_node_lookup",
    f"SELECT vec_id, CAST(CASE WHEN t < 1 THEN floor(5 * t) ELSE 4 END AS INTEGER) AS segment, round(CASE WHEN t < 1 THEN 5 * t - floor(5 * t) ELSE 1 END, 7) AS share, "
    + ", ".join(f"round(up[{i}] / array_distance(up, origin), 7) AS up_{c}" for i, c in enumerate("xyz", 1))
    + f" FROM (SELECT * EXCLUDE (t), (vec_id % 97) / 96.0::DOUBLE AS t, [(1 - t) * (CASE WHEN none THEN 0 ELSE a[1] END) + t * b[1], (1 - t) * (CASE WHEN none THEN 0 ELSE a[2] END) + t * b[2], (1 - t) * (CASE WHEN none THEN 1 ELSE a[3] END) + t * b[3]]::DOUBLE[3] AS up FROM (SELECT *, vec_id % 3 = 0 AS none FROM {POINTS}))",
)
def f41_node_lookup(spark, sf_dir):
    """Place on a path of six nodes; the direction upwards between two, of which the first has none in every third row."""
    rows = points(spark, sf_dir).withColumns({f"{p}{c}": F.expr(f"CASE WHEN vec_id % 3 = 0 THEN 0D ELSE {p}{c} END") for p in "a" for c in "xyz"}).withColumn("at", F.expr("(vec_id % 97) / 96.0D"))
    up = measures.up_at(vec.vec("a"), vec.vec("m"), "t")
    return rows.withColumns(measures.node_at("6", "at")).select("vec_id", "segment", F.round("share", 7).alias("share"), *(F.expr(f"round({e}, 7)").alias(f"up_{c}") for e, c in zip(up, "xyz", strict=True)))


@register(
    "f55_triangle_plane",
    "SELECT vec_id, " + ", ".join(f"round(n[{i}] / size, 7) AS n{c}" for i, c in enumerate("xyz", 1)) + f", round(array_inner_product(n, c) / size, 7) AS d FROM (SELECT *, array_distance(n, origin) AS size FROM (SELECT *, array_cross_product(ba, ca) AS n FROM {POINTS}))",
)
def f55_triangle_plane(spark, sf_dir):
    normal, d = measures.triangle_plane(vec.vec("a"), vec.vec("m"), vec.vec("c"))
    return points(spark, sf_dir).select("vec_id", *(F.expr(f"round({e}, 7)").alias(f"n{c}") for e, c in zip(normal, "xyz", strict=True)), F.expr(f"round({d}, 7)").alias("d"))


@register("f51_file_names", "SELECT p_partkey, replace(p_name, ' ', '_') || '.inp' AS name FROM part")
def f51_file_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", r"concat(CASE WHEN p_partkey % 2 = 0 THEN '/data.d/a b/' ELSE 'c:\\x\\' END, p_name, '.tg3') AS path")
    return rows.select("p_partkey", measures.file_name("path", ".inp").alias("name"))


@register("f52_wrapped_rows", "SELECT p_brand, CAST(k AS INTEGER) AS line_no, string_agg(CAST(p_partkey AS VARCHAR), ', ' ORDER BY p_partkey) AS value FROM (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 16 AS k FROM part) GROUP BY 1, 2")
def f52_wrapped(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    return rows.select("p_brand", F.posexplode(measures.wrapped("ids")).alias("line_no", "value"))


@register("j10_closest_within", f"SELECT vec_id, CAST(CASE WHEN min(far) <= 0.02 THEN arg_min(i, {{'far': far, 'i': i}}) ELSE -1 END AS INTEGER) AS place FROM (SELECT vec_id, i, pow(x1 - px, 2) + pow(y1 - py, 2) AS far FROM {EDGES}) GROUP BY vec_id")
def j10_closest_within(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", measures.closest_within("ring", "px", "py", "0.02D").alias("place"))


@register("s8_parameter_overrides", "SELECT event_id, m ->> '$.k' AS k, m ->> '$.unit' AS unit, m ->> '$.layers' AS layers FROM (SELECT event_id, json_merge_patch('{\"k\": -1, \"unit\": \"mm\", \"layers\": 5}', props) AS m FROM events)")
def s8_overrides(spark, sf_dir):
    merged = parameters.overridden({"k": -1, "unit": "mm", "layers": 5}, "props")
    return table(spark, sf_dir, "events").select("event_id", merged.alias("m")).selectExpr("event_id", "m['k'] AS k", "m['unit'] AS unit", "m['layers'] AS layers")


# Points and single yarns

_AT = "0.15 + ({k} // 4) * (0.7 / 3)", "0.15 + ({k} % 4) * (0.7 / 3)"


@register("j2b_one_yarn", f"SELECT vid, abs(y - ({_AT[0].format(k=5)})) < 0.15 AND abs(z - ({_AT[1].format(k=5)})) < 0.15 AS is_inside FROM {_MOVED}")
def j2b_one_yarn(spark, sf_dir):
    points_ = grids.centres(spark, (24, 24, 24), (0, 0.011, 0.023), (1, 1.011, 1.023))
    return exact.of_yarn(points_, fixtures.yarn_grid(spark, half=0.15), 5).selectExpr("vid", "is_inside")


_TWO = "(SELECT vid, abs(y - ({0})) < 0.15 AND abs(z - ({1})) < 0.15 AS one, abs(y - 0.1 - ({0})) < 0.15 AND abs(z - ({1})) < 0.15 AS two FROM {2})".format(_AT[0].format(k=5), _AT[1].format(k=5), _MOVED)


@register("j3b_first_image", f"SELECT vid, CAST(CASE WHEN one THEN 0 ELSE 1 END AS INTEGER) AS image FROM {_TWO} WHERE one OR two")
def j3b_first_image(spark, sf_dir):
    """The first of two images, a tenth apart, that holds each point."""
    points_ = grids.centres(spark, (24, 24, 24), (0, 0.011, 0.023), (1, 1.011, 1.023))
    yarns = fixtures.yarn_grid(spark, half=0.15).where("yarn_id = 5").withColumn("translations", F.expr("array(named_struct('x', 0D, 'y', 0D, 'z', 0D), named_struct('x', 0D, 'y', 0.1D, 'z', 0D))"))
    return exact.first_image(points_, yarns).selectExpr("vid", "CAST(image AS INT) AS image")


_CORNERS = "(SELECT k AS yarn_id, {0} + dy * 0.15 AS cy, {1} + dz * 0.15 AS cz FROM range(16) t(k), (VALUES (-1), (1)) a(dy), (VALUES (-1), (1)) b(dz))".format(_AT[0].format(k="k"), _AT[1].format(k="k"))


@register("j11_closest_surface", f"SELECT vid, round(sqrt(min(pow(y - cy, 2) + pow(z - cz, 2))), 7) AS distance FROM {_MOVED}, {_CORNERS} GROUP BY vid HAVING min(pow(y - cy, 2) + pow(z - cz, 2)) <= 0.01")
def j11_closest_surface(spark, sf_dir):
    """Corners of square sections in the plane across the yarn, within a tenth."""
    points_ = grids.centres(spark, (24, 24, 24), (0, 0.011, 0.023), (1, 1.011, 1.023))
    found = exact.closest_surface(points_, fixtures.yarn_grid(spark, half=0.15), within=0.1)
    return found.selectExpr("vid", "round(distance, 7) AS distance")
