"""Operators over levels, octrees, splines, files and surfaces against plain versions, and their edge cases."""

import random

import numpy as np

from loomspark.functions import cells, sections
from loomspark.operators import deform, levels, octree, yarns
from loomspark.sources import decks, drafts, exports


def plain_balance(leaves, shape):
    """Splits cells that touch one two levels finer until there are none."""
    found = set(leaves)
    while True:
        wrong = set()
        for level, *at in found:
            if level < 2:
                continue
            for shift in np.ndindex(3, 3, 3):
                near = [c + s - 1 for c, s in zip(at, shift)]
                if any(c < 0 or c >= n << level for c, n in zip(near, shape)):
                    continue
                for up in range(2, level + 1):
                    cell = (level - up, *(c >> up for c in near))
                    if cell in found:
                        wrong.add(cell)
        if not wrong:
            return found
        for level, x, y, z in wrong:
            found.discard((level, x, y, z))
            found |= {(level + 1, 2 * x + a, 2 * y + b, 2 * z + c) for a, b, c in np.ndindex(2, 2, 2)}


def refined(shape, targets):
    found = {(0, *at) for at in np.ndindex(*shape)}
    for depth, target in targets:
        for level in range(depth):
            cell = (level, *(t >> (depth - level) for t in target))
            if cell in found:
                found.discard(cell)
                _, x, y, z = cell
                found |= {(level + 1, 2 * x + a, 2 * y + b, 2 * z + c) for a, b, c in np.ndindex(2, 2, 2)}
    return found


def test_balance_is_the_coarsest(spark):
    pick = random.Random(5)
    shape = (2, 2, 1)
    leaves = refined(shape, [(5, tuple(pick.randrange(n << 5) for n in shape)) for _ in range(2)])
    df = spark.createDataFrame([tuple(int(v) for v in c) for c in leaves], "level int, ix long, iy long, iz long")
    got = {tuple(r) for r in octree.balance(df, shape).collect()}
    assert got == {tuple(int(v) for v in c) for c in plain_balance(leaves, shape)}
    assert octree.balance(df.where("false"), shape).count() == 0
    flat = df.where("level < 1").select("level", "ix", "iy", "iz")
    assert octree.balance(flat.unionAll(flat), shape).count() == flat.count()


def plain_levels(z, tolerance):
    z, i = sorted(z), 0
    while i < len(z) - 1:
        low, top = i == 0, i == len(z) - 2
        if abs(z[i] - z[i + 1]) < tolerance and not (low and top):
            z[i : i + 2] = [z[i] if low else z[i + 1] if top else 0.5 * (z[i] + z[i + 1])]
        else:
            i += 1
    return z


def test_merged_levels(spark):
    pick = random.Random(6)
    rows = [(i, [round(pick.random() * 3, 3) for _ in range(pick.randrange(0, 9))]) for i in range(200)]
    got = {r.id: r.levels for r in levels.merge_levels(spark.createDataFrame(rows, "id int, levels array<double>"), 0.2).collect()}
    for i, z in rows:
        assert np.allclose(got[i], plain_levels(z, 0.2))


def test_spline_points_solve_the_system(spark):
    pick = random.Random(7)
    nodes = [(y, k, pick.random(), pick.random(), pick.random()) for y, n in ((0, 6), (1, 2), (2, 3), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(nodes, "yarn_id int, node_idx int, x double, y double, z double")
    got = {(r.yarn_id, r.segment, r.j): r for r in yarns.spline_points(df, 4).collect()}
    assert len(got) == 4 * (5 + 1 + 2)
    for y, n in ((0, 6), (1, 2), (2, 3)):
        p = np.array([v[2:] for v in nodes if v[0] == y])
        a, b = np.eye(n), np.zeros((n, 3))
        for k in range(1, n - 1):
            a[k, k - 1 : k + 2] = 1, 4, 1
            b[k] = 6 * (p[k + 1] - 2 * p[k] + p[k - 1])
        m = np.linalg.solve(a, b)
        for k in range(n - 1):
            for j in range(4):
                t = j / 4
                want = (1 - t) * p[k] + t * p[k + 1] + ((1 - t) ** 3 - (1 - t)) * m[k] / 6 + (t**3 - t) * m[k + 1] / 6
                r = got[y, k, j]
                assert np.allclose((r.x, r.y, r.z), want)
                assert abs(r.tx**2 + r.ty**2 + r.tz**2 - 1) < 1e-9


def test_equal_distances_fall_back(spark):
    bad = sections.equally_spaced(lambda t: ("0D", "0D"), 4, rounds=5)
    assert spark.range(1).selectExpr(f"{bad} AS r").first().r == [(0.0, 0.0)] * 4


def test_cell_edits(spark):
    rows = spark.createDataFrame([(["X", "Y", "Y"],), ([],)], "c array<string>")
    got = [tuple(r) for r in rows.selectExpr(cells.push_down("c", 4), cells.push_up("c", 1), cells.delete_layers("c", "'Y'", 1)).collect()]
    assert got == [(["Y", "Y", "X"], ["Y", "X", "Y"], ["X", "Y"]), ([], [], [])]


def test_path_file_with_sections_and_domain(spark, tmp_path):
    text = "** head\n1\n** type\nn/a\n** repeats\n4,\t2,\t1,\t0,\t0,\t1\n** Vector\n7,\t1,\t0,\t0,\t0,\t1,\t2,\t3\n5,\t0,\t1,\t1\n0,\t1,\t0,\t0,\t0\n** End\n** Vector\n8,\t1,\t1,\t2,\t3,\t4,\t4,\t4\n5,\t1,\t1,\t1\n0,\t1,\t0,\t0,\t0\n** End\n[SECTIONS]\n** Section 1 Start\nE(0.5)\t7,\t2,\t2,\t0\n1,\t0.25,\t0\n2,\t-0.25,\t0\n** Section 1 End\n[DOMAIN]\n0, 0, 0, 1, 2, 3\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("\n")
    lattice, nodes, points, domain = drafts.parse_paths(decks.read_lines(spark, str(tmp_path)))
    assert [tuple(r)[1:] for r in lattice.collect()] == [(4, 2, 1, 0, 0, 1)]
    assert [tuple(r)[1:] for r in nodes.orderBy("node_idx").collect()] == [(5, 7, 0, 0, 0, 0, 0, 0, 1), (5, 7, 1, 1, 2, 3, 0, 0, 1), (5, 7, 2, 4, 4, 4, 0, 0, 1)]
    assert [tuple(r)[1:] for r in points.orderBy("pt_idx").collect()] == [(7, 0, 0.25, 0), (7, 1, -0.25, 0)]
    assert [tuple(r)[1:] for r in domain.collect()] == [(0, 0, 0, 1, 2, 3)]


def test_draft_options_and_bad_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 2 1\nWIDTH 12.5 mm\nORTHOGONAL\n121\n1x1\n\n212\n")
    layers, found, options = drafts.parse_draft(decks.read_lines(spark, str(tmp_path)))
    assert [r.yarns for r in layers.orderBy("warp").collect()] == [1, 2, 1]
    assert sorted((r.weft, r.warp, r.level) for r in found.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 1, 1), (1, 2, 2)]
    assert {(r.keyword, r.number, r.unit) for r in options.collect()} == {("WIDTH", 12.5, "mm"), ("ORTHOGONAL", None, None)}


def test_surfaces_without_area_and_yarns_without_triangles(spark):
    points = spark.createDataFrame([(0, 0, 0.2, 0.2), (1, 1, 0.0, 0.0), (2, 0, 9.0, 9.0)], "point_id int, yarn_id int, x double, y double")
    tri = spark.createDataFrame([(0, 0, *[0.0] * 9), (1, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)], "tri_id int, yarn_id int, x0 double, y0 double, d0 double, x1 double, y1 double, d1 double, x2 double, y2 double, d2 double")
    got = {r.point_id: (round(r.dz, 9), r.accuracy >= 0) for r in deform.surface_displacement(points, tri, 0.3).collect()}
    assert got == {0: (1.0, True), 2: (1.0, False)}


def test_sections_need_every_corner(spark):
    p = lambda *v: [(float(a), float(b), 0.0) for a, b in v]
    schema = "{} int, key int, {}points array<struct<x:double,y:double,z:double>>"
    square, other = p((0, 0), (1, 0), (1, 1), (0, 1)), p((0, 0), (1, 0), (1, 1), (0, 2))
    polygons = spark.createDataFrame([(0, 0, square), (1, 0, other), (2, 0, [])], schema.format("poly_id", ""))
    images = spark.createDataFrame([(0, 0, square[2:] + square[:2]), (0, 1, square), (0, 2, square[:3])], "key int, image int, points array<struct<x:double,y:double,z:double>>")
    assert [tuple(r) for r in deform.match_sections(polygons, images).collect()] == [(0, 0, 2)]


def test_hexes_are_numbered_across_ranges(spark):
    voxels = spark.range(70_000).selectExpr("id AS vid", "CASE WHEN id % 2 = 0 THEN NULL ELSE 3 END AS yarn_id")
    got = exports.hex_elements(voxels, (100, 100, 7), matrix=False).orderBy("vid").select("elem_id").collect()
    assert [r.elem_id for r in got] == list(range(1, 35_001))


def test_moving_keeps_other_columns_and_lengths(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, "a"), (2, None, 0.0, 0.0, "b")], "id int, x double, y double, z double, note string")
    one, two = deform.move(df, (1, 1, 1), 0.7).orderBy("id").collect()
    assert one.note == "a" and abs(one.x**2 + one.y**2 + one.z**2 - 14) < 1e-9
    assert (two.x, two.y, two.z) == (None, None, None)


def test_triangles_come_before_quads(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    schema = "key int, type string, elem_id int, ring array<struct<x:double,y:double>>"
    elements = spark.createDataFrame([(0, "QUAD", 0, ring), (0, "TRI", 5, ring[:3]), (0, "TRI", 6, ring[:3]), (0, "TRI", 1, []), (1, "QUAD", 3, ring)], schema)
    points = spark.createDataFrame([(0, 0, 1.5, 0.5), (1, 0, 0.5, 1.5), (2, 1, 1.5, 0.5), (3, 1, 5.0, 5.0)], "point_id int, key int, x double, y double")
    got = {tuple(r) for r in deform.section_elements(points, elements).collect()}
    assert got == {(0, "TRI", 5), (1, "QUAD", 0), (2, "QUAD", 3)}
