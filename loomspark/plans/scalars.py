"""Queries over the scalar functions: vectors from ``embeddings``, sections from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import polygons, sections, vec
from loomspark.functions.vec import Vec
from loomspark.plans.registry import register
from loomspark.session import table

A, B, C, D = (vec.vec(p) for p in "amcd")
_AXES = [f"{p}{c}" for p in "amcd" for c in "xyz"]


def points(spark, sf_dir):
    """a, b, c, d: the first twelve components; t: a parameter in [0, 1); ring: the first eight pairs."""
    picked = [F.expr(f"CAST(embedding[{i}] AS DOUBLE)").alias(n) for i, n in enumerate(_AXES)]
    ring = F.expr("transform(sequence(0, 7), i -> named_struct('x', CAST(embedding[2 * i] AS DOUBLE), 'y', CAST(embedding[2 * i + 1] AS DOUBLE)))")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *picked, F.expr("(vec_id % 97) / 97.0D").alias("t"), ring.alias("ring"), F.expr("CAST(embedding[16] AS DOUBLE)").alias("px"), F.expr("CAST(embedding[17] AS DOUBLE)").alias("py"))


#: The same points for the SQL side, as arrays of three, with the differences that formulas need. The SQL below is written from the
#: definitions - arrays' inner and cross products, de Casteljau's construction, areas - and shares no text with the functions.
_ARRAY = "[CAST(embedding[{0}] AS DOUBLE), CAST(embedding[{1}] AS DOUBLE), CAST(embedding[{2}] AS DOUBLE)]::DOUBLE[3]"
_LESS = "[{0}[1] - {1}[1], {0}[2] - {1}[2], {0}[3] - {1}[3]]::DOUBLE[3] AS {2}"
_ALONG = "[{0}[1] + {2} * ({1}[1] - {0}[1]), {0}[2] + {2} * ({1}[2] - {0}[2]), {0}[3] + {2} * ({1}[3] - {0}[3])]::DOUBLE[3] AS {3}"
POINTS = (
    "(SELECT *, " + ", ".join(_LESS.format(x, y, x + y) for x, y in ("ab", "ac", "ba", "ca", "cb", "da", "db", "dc", "bc")) + " FROM (SELECT vec_id, (vec_id % 97) / 97.0::DOUBLE AS t, "
    "CAST(embedding[17] AS DOUBLE) AS px, CAST(embedding[18] AS DOUBLE) AS py, [0, 0, 0]::DOUBLE[3] AS origin, "
    + ", ".join(f"{_ARRAY.format(3 * i + 1, 3 * i + 2, 3 * i + 3)} AS {n}" for i, n in enumerate("abcd"))
    + " FROM embeddings))"
)
EDGES = "(SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x1, CAST(embedding[2 * i + 2] AS DOUBLE) AS y1, CAST(embedding[2 * ((i + 1) % 8) + 1] AS DOUBLE) AS x2, CAST(embedding[2 * ((i + 1) % 8) + 2] AS DOUBLE) AS y2, CAST(embedding[17] AS DOUBLE) AS px, CAST(embedding[18] AS DOUBLE) AS py FROM embeddings, range(8) r(i))"


def _over_points(name: str, expressions: dict[str, str], sql: str) -> None:
    """``expressions`` by name, of the functions; ``sql`` gives the same columns."""
    found = {k: (v if k.startswith("is_") else f"round({v}, 7)") for k, v in expressions.items()}
    shown = ", ".join(k if k.startswith("is_") else f"round({k}, 7) AS {k}" for k in found)

    @register(name, f"SELECT vec_id, {shown} FROM ({sql})")
    def query(spark, sf_dir):
        return points(spark, sf_dir).select("vec_id", *(F.expr(v).alias(k) for k, v in found.items()))


def _parts(name: str, array: str) -> str:
    return ", ".join(f"{array}[{i}] AS {name}_{c}" for i, c in enumerate("xyz", 1))


def _casteljau(p: str, q: str, r: str, s: str) -> str:
    """``point`` and ``tangent`` of a cubic whose control points are named, from ``POINTS`` or what has these columns and ``t``."""
    line = lambda x, y, to: _ALONG.format(x, y, "t", to)
    first = f"SELECT *, {line(p, q, 'u1')}, {line(q, r, 'u2')}, {line(r, s, 'u3')} FROM "
    second = f"SELECT *, {line('u1', 'u2', 'v1')}, {line('u2', 'u3', 'v2')} FROM ("
    return f"SELECT *, {line('v1', 'v2', 'w')}, [3 * (v2[1] - v1[1]), 3 * (v2[2] - v1[2]), 3 * (v2[3] - v1[3])] AS slope FROM ({second}{first}{{0}}))"


def _xyz(name: str, v: Vec) -> dict[str, str]:
    return {f"{name}_{c}": e for c, e in zip("xyz", v, strict=True)}


_over_points(
    "f1_vector_arithmetic",
    _xyz("added", vec.add(A, B)) | _xyz("less", vec.sub(A, B)) | _xyz("scaled", vec.scale(A, "2.5")) | _xyz("times", vec.mul(A, B)),
    f"SELECT vec_id, {_parts('added', 'plus')}, {_parts('less', 'ab')}, {_parts('scaled', 'more')}, {_parts('times', 'product')} FROM (SELECT *, "
    f"list_transform(list_zip(a, b), lambda z: z[1] + z[2]) AS plus, list_transform(a, lambda v: 5 * v / 2) AS more, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) AS product FROM {POINTS})",
)
_over_points("f2_dot_cross", {"dotted": vec.dot(A, B)} | _xyz("crossed", vec.cross(A, B)), f"SELECT vec_id, array_inner_product(a, b) AS dotted, {_parts('crossed', 'array_cross_product(a, b)')} FROM {POINTS}")
_over_points(
    "f3_length",
    {"len_a": vec.length(A), "len_ab": vec.length(vec.sub(A, B)), "squared": vec.dot(A, A)},
    f"SELECT vec_id, array_distance(a, origin) AS len_a, array_distance(a, b) AS len_ab, pow(array_distance(a, origin), 2) AS squared FROM {POINTS}",
)
_over_points("f4_normalise", _xyz("unit", vec.normalise(A)), f"SELECT vec_id, {_parts('unit', 'list_transform(a, lambda v: v / array_distance(a, origin))')} FROM {POINTS}")
_over_points(
    "f5_min_max",
    _xyz("low", vec.least(A, B)) | _xyz("high", vec.greatest(A, B)) | {"largest": "greatest(ax, ay, az)"},
    f"SELECT vec_id, {_parts('low', 'list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] < z[2] THEN z[1] ELSE z[2] END)')}, "
    f"{_parts('high', 'list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] < z[2] THEN z[2] ELSE z[1] END)')}, list_max(a) AS largest FROM {POINTS}",
)
# Rodrigues' formula: v cos + (k x v) sin + k (k . v) (1 - cos)
_over_points(
    "f6_quaternion_rotate",
    _xyz("turned", vec.rotate(vec.quaternion(B, "cx"), A)),
    "SELECT vec_id, " + ", ".join(f"a[{i}] * cos(c[1]) + array_cross_product(k, a)[{i}] * sin(c[1]) + k[{i}] * array_inner_product(k, a) * (1 - cos(c[1])) AS turned_{x}" for i, x in enumerate("xyz", 1)) + f" FROM (SELECT *, list_transform(b, lambda v: v / array_distance(b, origin))::DOUBLE[3] AS k FROM {POINTS})",
)
_line = vec.closest_on_line(A, B, C)
_over_points(
    "f7_point_line",
    {"u": _line[0], "gap": vec.length(vec.sub(A, _line[1]))} | _xyz("foot", _line[1]),
    "SELECT vec_id, u, array_distance(array_cross_product(ab, cb), origin) / array_distance(c, b) AS gap, " + ", ".join(f"(1 - u) * b[{i}] + u * c[{i}] AS foot_{x}" for i, x in enumerate("xyz", 1)) + f" FROM (SELECT *, array_inner_product(ab, cb) / array_inner_product(cb, cb) AS u FROM {POINTS})",
)
# a + u1 (b - a) = c + u2 (d - c): Cramer's rule; null if the lines are parallel
_den = "nullif((mx - ax) * (dy - cy) - (my - ay) * (dx - cx), 0)"
_over_points(
    "f8_segment_cross_2d",
    {"u1": f"((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / {_den}", "u2": f"((cx - ax) * (my - ay) - (cy - ay) * (mx - ax)) / {_den}"},
    f"SELECT vec_id, (ca[2] * -dc[1] + ca[1] * dc[2]) / det AS u1, (ba[2] * ca[1] - ba[1] * ca[2]) / det AS u2 FROM (SELECT *, nullif(dc[2] * ba[1] - dc[1] * ba[2], 0) AS det FROM {POINTS})",
)
_meet = vec.line_plane(A, B, C, D)
_over_points(
    "f9_line_plane",
    {"u": _meet[0]} | _xyz("at", _meet[1]),
    f"SELECT vec_id, u, a[1] + ba[1] * u AS at_x, a[2] + ba[2] * u AS at_y, a[3] + ba[3] * u AS at_z FROM (SELECT *, array_inner_product(ca, d) / nullif(array_inner_product(ba, d), 0) AS u FROM {POINTS})",
)
# the foot's barycentric coordinates by Gram's matrix; outside, the nearest of three segments
_to_edge = "(SELECT sqrt(greatest(0, pow(array_distance(d, {0}), 2) - 2 * s * array_inner_product(d{0}, {1}{0}) + s * s * pow(array_distance({1}, {0}), 2))) FROM (SELECT greatest(0, least(1, array_inner_product(d{0}, {1}{0}) / pow(array_distance({1}, {0}), 2))) AS s))"
_over_points(
    "f10_point_triangle",
    {"distance": vec.triangle_distance(D, A, B, C)},
    f"SELECT vec_id, CASE WHEN v >= 0 AND w >= 0 AND v + w <= 1 THEN abs(array_inner_product(da, n)) / array_distance(n, origin) ELSE least(e1, e2, e3) END AS distance FROM (SELECT *, (gc * pb - gm * pc) / (gb * gc - gm * gm) AS v, (gb * pc - gm * pb) / (gb * gc - gm * gm) AS w FROM ("
    "SELECT *, array_cross_product(ba, ca) AS n, array_inner_product(ba, ba) AS gb, array_inner_product(ca, ca) AS gc, array_inner_product(ba, ca) AS gm, array_inner_product(da, ba) AS pb, array_inner_product(da, ca) AS pc, "
    + ", ".join(f"{_to_edge.format(x, y)} AS e{i}" for i, (x, y) in enumerate((("a", "b"), ("b", "c"), ("a", "c")), 1))
    + f" FROM {POINTS}))",
)
# weights of the corners by the squared sides opposite to them
_over_points(
    "f11_circumcentre",
    _xyz("centre", vec.circumcentre(A, B, C)),
    "SELECT vec_id, " + ", ".join(f"(wa * a[{i}] + wb * b[{i}] + wc * c[{i}]) / (wa + wb + wc) AS centre_{x}" for i, x in enumerate("xyz", 1)) + f" FROM (SELECT *, qa * (qb + qc - qa) AS wa, qb * (qc + qa - qb) AS wb, qc * (qa + qb - qc) AS wc FROM (SELECT *, array_inner_product(bc, bc) AS qa, array_inner_product(ac, ac) AS qb, array_inner_product(ab, ab) AS qc FROM {POINTS}))",
)
# areas of the three triangles with the point; noughts if the whole has less than the limit
_area2 = "(({1}[1] - {0}[1]) * ({2}[2] - {0}[2]) - ({1}[2] - {0}[2]) * ({2}[1] - {0}[1]))"
_over_points(
    "f12_barycentric",
    _xyz("weight", vec.barycentric(D, A, B, C)),
    "SELECT vec_id, " + ", ".join(f"CASE WHEN abs(whole) < 1e-6 THEN 0 ELSE {part} / whole END AS weight_{x}" for x, part in zip("xyz", (_area2.format("d", "b", "c"), _area2.format("a", "d", "c"), _area2.format("a", "b", "d")), strict=True)) + f" FROM (SELECT *, {_area2.format('a', 'b', 'c')} AS whole FROM {POINTS})",
)
_over_points(
    "f13_bezier",
    _xyz("point", vec.bezier((A, B, C, D), "t")) | _xyz("tangent", vec.bezier_tangent((A, B, C, D), "t")),
    f"SELECT vec_id, {_parts('point', 'w')}, {_parts('tangent', 'slope')} FROM ({_casteljau(*'abcd').format(POINTS)})",
)
# up without its share along the tangent, to length one: what is left of it is (t x b) x t
_FRAMES = (
    "(SELECT *, array_cross_product(tangent, upward) AS side FROM (SELECT *, list_transform(flat, lambda v: v / array_distance(flat, origin))::DOUBLE[3] AS upward FROM "
    f"(SELECT *, array_cross_product(array_cross_product(tangent, b), tangent) AS flat FROM (SELECT *, list_transform(a, lambda v: v / array_distance(a, origin))::DOUBLE[3] AS tangent FROM {POINTS}))))"
)
_frame = vec.frame(vec.normalise(A), B)
_over_points("f14_f42_frame", _xyz("upward", _frame[0]) | _xyz("side", _frame[1]), f"SELECT vec_id, {_parts('upward', 'upward')}, {_parts('side', 'side')} FROM {_FRAMES}")
_over_points(
    "f43_section_to_space",
    _xyz("point", vec.add(C, vec.add(vec.scale(_frame[1], "px"), vec.scale(_frame[0], "py")))),
    "SELECT vec_id, " + ", ".join(f"c[{i}] + side[{i}] * px + upward[{i}] * py AS point_{x}" for i, x in enumerate("xyz", 1)) + f" FROM {_FRAMES}",
)
_over_points(
    "f47_linear_transform",
    {f"row{i}": row for i, row in enumerate(vec.transformed((B, C, D), A))},
    f"SELECT vec_id, array_inner_product(b, a) AS row0, array_inner_product(c, a) AS row1, array_inner_product(d, a) AS row2 FROM {POINTS}",
)
_over_points(
    "f48_determinant_inverse",
    {"det": vec.determinant((A, B, C))} | {f"inv{i}{j}": e for i, row in enumerate(vec.inverse((A, B, C))) for j, e in enumerate(row)},
    "SELECT vec_id, det, " + ", ".join(f"{'' if (i + j) % 2 == 0 else '-'}({m[0]} * {m[3]} - {m[1]} * {m[2]}) / nullif(det, 0) AS inv{i}{j}" for i in range(3) for j in range(3) for m in [[f"{r}[{c + 1}]" for k, r in enumerate("abc") if k != j for c in range(3) if c != i]])
    + f" FROM (SELECT *, a[1] * b[2] * c[3] + a[2] * b[3] * c[1] + a[3] * b[1] * c[2] - a[3] * b[2] * c[1] - a[1] * b[3] * c[2] - a[2] * b[1] * c[3] AS det FROM {POINTS})",
)
_over_points("f16_round_half_away", {"is_rounded": vec.round_half_away("ax * 100")}, f"SELECT vec_id, CAST(round(a[1] * 100) AS INTEGER) AS is_rounded FROM {POINTS}")
_over_points(
    "p1_point_in_box",
    {"is_in": vec.in_box(A, vec.least(B, C), vec.greatest(B, C), "1e-9")},
    f"SELECT vec_id, len(list_filter([1, 2, 3], lambda i: a[i] BETWEEN least(b[i], c[i]) - 1e-9 AND greatest(b[i], c[i]) + 1e-9)) = 3 AS is_in FROM {POINTS}",
)
_over_points(
    "p2_boxes_meet",
    {"is_meeting": vec.boxes_meet(vec.least(A, B), vec.greatest(A, B), vec.least(C, D), vec.greatest(C, D))},
    f"SELECT vec_id, len(list_filter([1, 2, 3], lambda i: greatest(least(a[i], b[i]), least(c[i], d[i])) > least(greatest(a[i], b[i]), greatest(c[i], d[i])))) = 0 AS is_meeting FROM {POINTS}",
)
_over_points(
    "p3_point_in_half_spaces",
    {"is_in": " AND ".join(vec.inside_plane(A, n, d) for n, d in ((("1", "0", "0"), "-0.1"), (("-1", "0", "0"), "-0.1"), (("0", "0.6", "0.8"), "-0.05"), (("0", "-0.6", "-0.8"), "-0.05")))},
    f"SELECT vec_id, abs(a[1]) <= 0.1 - 1e-9 AND abs(3 * a[2] + 4 * a[3]) <= 0.25 - 5e-9 AS is_in FROM {POINTS}",
)
_over_points(
    "p7_point_in_triangle",
    {"is_in": vec.in_triangle_2d(D, A, B, C)},
    f"SELECT vec_id, abs({_area2.format('d', 'a', 'b')}) + abs({_area2.format('d', 'b', 'c')}) + abs({_area2.format('d', 'c', 'a')}) <= abs({_area2.format('a', 'b', 'c')}) * (1 + 1e-12) AS is_in FROM {POINTS}",
)
_over_points("p9_spheres_meet", {"is_meeting": vec.spheres_meet(A, "abs(mx)", C, "abs(my)")}, f"SELECT vec_id, array_distance(a, c) <= abs(b[1]) + abs(b[2]) AS is_meeting FROM {POINTS}")
_over_points(
    "j12_tet_volume_weights",
    {"volume": vec.tet_volume(A, B, C, D), "is_inverted": f"({vec.tet_volume(A, B, C, D)} < 0)"},
    f"SELECT vec_id, v AS volume, v < 0 AS is_inverted FROM (SELECT *, array_inner_product(ba, array_cross_product(ca, da)) / 6 AS v FROM {POINTS})",
)
_over_points(
    "f38_path_bezier",
    _xyz("path", vec.path_bezier(A, C, B, D, "t")),
    f"SELECT vec_id, {_parts('path', 'w')} FROM ({_casteljau('a', 'h1', 'h2', 'b').format('(SELECT *, list_transform(list_zip(a, c), lambda z: z[1] + third * z[2])::DOUBLE[3] AS h1, list_transform(list_zip(b, d), lambda z: z[1] - third * z[2])::DOUBLE[3] AS h2 FROM (SELECT *, array_distance(a, b) / 3 AS third FROM ' + POINTS + '))')})",
)
_over_points("f37_path_linear", _xyz("path", vec.path_linear(A, B, "t")), "SELECT vec_id, " + ", ".join(f"(1 - t) * a[{i}] + t * b[{i}] AS path_{x}" for i, x in enumerate("xyz", 1)) + f" FROM {POINTS}")


def _over_rings(name: str, spark_columns: dict[str, str], oracle_columns: dict[str, str]) -> None:
    sql = f"SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in oracle_columns.items())} FROM {EDGES} GROUP BY vec_id"

    @register(name, sql)
    def query(spark, sf_dir):
        return points(spark, sf_dir).select("vec_id", *(F.expr(v).alias(k) for k, v in spark_columns.items()))


_box = polygons.box("ring")
_over_rings("f22_a13_shoelace_area", {"area": f"round({polygons.area('ring')}, 7)"}, {"area": "round(sum(x1 * y2 - x2 * y1) / 2, 7)"})
_over_rings("f15_projected_area", {"area": f"round({polygons._fold('ring', 'a + (p.x - q.x) * (p.y + q.y) / 2')}, 7)"}, {"area": "round(sum((x1 - x2) * (y1 + y2)) / 2, 7)"})
_over_rings("f23_circumference", {"around": f"round({polygons.circumference('ring')}, 7)"}, {"around": "round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 7)"})
_over_rings("f19_polygon_box", dict(zip(("x_lo", "y_lo", "x_hi", "y_hi"), _box, strict=True)), {"x_lo": "min(x1)", "y_lo": "min(y1)", "x_hi": "max(x1)", "y_hi": "max(y1)"})
_over_rings("f21_p5_inside_half_open", {"is_in": polygons.inside_half_open("ring", "px", "py")}, {"is_in": "sum(CASE WHEN (y1 > py) != (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1"})
_over_rings("f20_p4_inside_closed", {"is_in": polygons.inside_closed("ring", "px", "py")}, {"is_in": "sum(CASE WHEN py > least(y1, y2) AND py <= greatest(y1, y2) AND px <= greatest(x1, x2) AND y1 != y2 AND (x1 = x2 OR px <= (py - y1) * (x2 - x1) / (y2 - y1) + x1) THEN 1 ELSE 0 END) % 2 = 1"})
_dist = "((y2 - y1) * (px - x1) - (x2 - x1) * (py - y1)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"
_over_rings("f24_edge_distance", {"distance": f"round({polygons.edge_distance('ring', 'px', 'py')}, 7)"}, {"distance": f"round(coalesce(max({_dist}) FILTER (WHERE {_dist} < 1e-9), 1), 7)"})
_over_rings("a14_quadratic_integral", {"second": f"round({polygons.moments('ring')}, 7)"}, {"second": "round(sum((x1 * y2 - x2 * y1) * (x1 * x1 + x1 * x2 + x2 * x2)) / 12, 7)"})


def _over_parts(name: str, point: tuple[str, str], x: str, y: str, more: str = "") -> None:
    """Sixteen points of each part's section; width is p_size, height its hundredth of the price (F33). ``x`` and ``y`` are
    the SQL's, over w, h, i and the ``more`` that it names."""
    sql = f"SELECT p_partkey, i, round({x}, 6) + 0.0 AS x, round({y}, 6) + 0.0 AS y FROM (SELECT * {more} FROM (SELECT p_partkey, i, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS h FROM part, range(16) r(i)))"

    @register(name, sql)
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("CAST(p_size AS DOUBLE)").alias("w"), F.expr("p_retailprice / 100").alias("h"), F.explode(F.expr("sequence(0L, 15L)")).alias("i"))
        return rows.withColumn("t", F.expr("i / 16.0D")).selectExpr("p_partkey", "i", f"round({point[0]}, 6) + 0.0D AS x", f"round({point[1]}, 6) + 0.0D AS y")


# a circle of sixteen steps, and a walk round a rectangle from the middle of its right side: up, left, down, right, up
_ANGLE = ", radians(22.5 * i) AS g"
_WALK = ", i * (w + h) / 8 AS s, i * (w + h) / 8 - h / 2 AS s1, i * (w + h) / 8 - h / 2 - w AS s2, i * (w + h) / 8 - 1.5 * h - w AS s3, i * (w + h) / 8 - 1.5 * h - 2 * w AS s4"
_WALK_X = "CASE WHEN s4 > 0 OR s1 <= 0 THEN w / 2 WHEN s3 > 0 THEN s3 - w / 2 WHEN s2 > 0 THEN -w / 2 ELSE w / 2 - s1 END"
_WALK_Y = "CASE WHEN s4 > 0 THEN s4 - h / 2 WHEN s3 > 0 THEN -h / 2 WHEN s2 > 0 THEN h / 2 - s2 WHEN s1 > 0 THEN h / 2 ELSE s END"
_over_parts("f25_section_ellipse", sections.ellipse("w", "h", "t"), "w / 2 * cos(g)", "h / 2 * sin(g)", _ANGLE)
_over_parts(
    "f26_section_power_ellipse",
    sections.power_ellipse("w", "h", "0.7", "t", "0.1"),
    "CASE WHEN i <= 4 OR i >= 12 THEN (w / 2 - 0.1) * cos(g) ELSE (w / 2 + 0.1) * cos(g) END + 0.1",
    "CASE WHEN i IN (0, 8) THEN 0 WHEN i < 8 THEN h / 2 * exp(0.7 * ln(abs(sin(g)))) ELSE -h / 2 * exp(0.7 * ln(abs(sin(g)))) END",
    _ANGLE,
)
# half chord c and rise e of an arc give its radius (c c + e e) / 2e; equal steps of the angle at its centre
_over_parts(
    "f27_section_lenticular",
    sections.lenticular("(w + 10)", "(h / 10)", "t", "0.1"),
    "r * sin(part * asin(c / r))",
    "CASE WHEN i < 8 THEN r * cos(part * asin(c / r)) - r + h / 20 ELSE r - h / 20 - r * cos(part * asin(c / r)) END",
    ", (w + 10) / 2 AS c, CASE WHEN i < 8 THEN 1 - i / 4.0 ELSE i / 4.0 - 3 END AS part, (pow((w + 10) / 2, 2) + pow(h / 20 + CASE WHEN i < 8 THEN -0.1 ELSE 0.1 END, 2)) / (2 * (h / 20 + CASE WHEN i < 8 THEN -0.1 ELSE 0.1 END)) AS r",
)
_over_parts("f28_section_rectangle", sections.rectangle("w", "h", "t"), _WALK_X, _WALK_Y, _WALK)
_over_parts(
    "f31_section_hybrid",
    sections.hybrid([("t < 0.5", sections.ellipse("w", "h", "t")), ("", sections.rectangle("w", "h", "t"))]),
    f"CASE WHEN i < 8 THEN w / 2 * cos(g) ELSE {_WALK_X} END",
    f"CASE WHEN i < 8 THEN h / 2 * sin(g) ELSE {_WALK_Y} END",
    _ANGLE + _WALK,
)
# a turned and then scaled ellipse
_over_parts(
    "f32_section_rotated_scaled",
    sections.scaled(sections.rotated(sections.ellipse("w", "h", "t"), "0.3"), "1.5", "0.5"),
    "0.75 * (w * cos(g) * cos(0.3) - h * sin(g) * sin(0.3))",
    "0.25 * (w * cos(g) * sin(0.3) + h * sin(g) * cos(0.3))",
    _ANGLE,
)
# smooth step of a quarter: 3 / 16 - 2 / 64 = 5 / 32 of the way
_over_parts(
    "f34_section_interpolated",
    sections.between(sections.ellipse("w", "h", "t"), sections.rectangle("w", "h", "t"), "0.25", smooth=True),
    f"27 * w * cos(g) / 64 + 5 * ({_WALK_X}) / 32",
    f"27 * h * sin(g) / 64 + 5 * ({_WALK_Y}) / 32",
    _ANGLE + _WALK,
)
