"""Behaviour that the queries don't show: known answers, errors and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.units import convert
from loomspark.operators import classify, mesh, yarns
from loomspark.sources import decks, fixtures, grids


def test_square_yarn_has_sixteen_of_64_cells(spark):
    found = classify.voxelize(fixtures.square_yarn(spark), 4, 4, 4)
    assert found.count() == 64
    assert found.where("yarn_id >= 0").count() == 16


def test_pruning_keeps_the_answer_between_the_ends(spark):
    pruned = classify.voxelize(fixtures.square_yarn(spark), 6, 6, 6)
    whole = classify.voxelize(fixtures.square_yarn(spark), 6, 6, 6, pruning=False)
    key = lambda df: sorted((r.vid, r.yarn_id) for r in df.collect())
    assert key(pruned) == key(whole)


def test_straight_yarns_have_128_cells_each(spark):
    found = classify.voxelize(fixtures.yarn_grid(spark), 32, 32, 32).where("yarn_id >= 0").groupBy("yarn_id").count().collect()
    assert sorted((r.yarn_id, r["count"]) for r in found) == [(i, 128) for i in range(16)]


def test_images_beyond_the_broadcast_limit_shuffle_to_the_same(spark, monkeypatch):
    want = classify.voxelize(fixtures.yarn_grid(spark), 8, 8, 8).collect()
    monkeypatch.setattr(classify, "_few", lambda found: False)
    assert sorted(map(str, classify.voxelize(fixtures.yarn_grid(spark), 8, 8, 8).collect())) == sorted(map(str, want))


def test_refinement_fills_the_box(spark):
    from loomspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    cells = classify.refine(fixtures.square_yarn(spark), (2, 2, 2), 1)
    row = cells.agg(F.sum(F.expr("dx * dy * dz")).alias("v"), F.max("level").alias("l"), F.count("*").alias("n")).first()
    assert row.n > 8 and row.l == 1
    assert row.v == pytest.approx(1.0)
    with pytest.raises(ValueError):
        classify.refine(fixtures.square_yarn(spark), (2, 2, 2), 1, most=3)


def test_grids_refuse_bad_shapes(spark):
    for call in (lambda: grids.cells(spark, 0, 1, 1), lambda: grids.corners(spark, (1, 2, 2)), lambda: grids.staggered(spark, (7, 2, 2), 0.5)):
        with pytest.raises(ValueError):
            call()


def test_components_of_a_long_path(spark):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b").unionAll(spark.range(100, 103).selectExpr("id AS a", "id + 1 AS b"))
    found = {r.node: r.root for r in mesh.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_spline_solves_the_system(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(7, 3))
    rows = spark.createDataFrame([(1, i, *map(float, q)) for i, q in enumerate(p)] + [(2, 0, 1.0, 2.0, 3.0)], "yarn_id int, node_idx int, x double, y double, z double")
    got = sorted((r.yarn_id, r.node_idx, r.mx, r.my, r.mz) for r in yarns.spline(rows).collect())
    a = np.diag(np.full(5, 4.0)) + np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    want = np.linalg.solve(a, 6 * (p[2:] - 2 * p[1:-1] + p[:-2]))
    np.testing.assert_allclose([g[2:] for g in got[1:6]], want)
    assert got[-1] == (2, 0, 0.0, 0.0, 0.0)


def test_deck_file_round_trip(spark, tmp_path):
    nodes = grids.corners(spark, (3, 3, 3)).select("node_id", "x", "y", "z")
    hexes = grids.hexes(spark, 2, 2, 2)
    sets = hexes.selectExpr("'all' AS set_name", "elem_id")
    decks.write_lines(decks.deck_lines(nodes, hexes, sets), str(tmp_path / "deck"))
    n, e, s = decks.parse_deck(decks.read_lines(spark, str(tmp_path / "deck")))
    assert n.count() == 27 and e.count() == 8 and s.count() == 8
    assert sorted(map(str, e.collect())) == sorted(map(str, hexes.collect()))


def test_deck_continued_lines_and_ranges(spark):
    text = ["** comment", "*Node", "1, 0, 0, 0", "2, 1, 0, 0", "*Element, type=C3D8R", "7, 1, 2,", "1, 2, 1, 2, 1, 2", "*Elset, elset=Even, generate", "2, 8, 2"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "file string, line_no int, value string")
    n, e, s = decks.parse_deck(lines)
    assert n.count() == 2
    assert e.first().nodes == [1, 2, 1, 2, 1, 2, 1, 2]
    assert sorted(r.elem_id for r in s.collect()) == [2, 4, 6, 8]


def test_model_xml_round_trip(spark, tmp_path):
    nodes = yarns.weave(spark, 2, 2, 1.0, 0.2, ((0, 0), (1, 1))).withColumn("textile", F.lit("weave"))
    decks.write_model(nodes, str(tmp_path / "model"))
    back = decks.read_model(spark, str(tmp_path / "model"))
    key = lambda df: sorted(map(tuple, df.select("textile", "yarn_id", "node_idx", "x", "y", "z").collect()))
    assert key(back) == key(nodes)


def test_units(spark):
    row = spark.range(1).select(convert(F.lit(2.5), "mm", "m").alias("a"), convert(F.lit(1.0), "g/cm^3", "kg/m^3").alias("b"), convert(F.lit(1.0), "tex", "m").alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0025, 1000.0, None)
    with pytest.raises(ValueError):
        convert(F.lit(1.0), "m", "furlong")


def test_models_by_name(spark):
    from loomspark.sources.registry import Models

    models = Models(spark)
    with pytest.raises(KeyError):
        models.get()
    assert [models.add(spark.range(n), "weave") for n in (1, 2, 3)] == ["weave", "weave-2", "weave-3"]
    assert models.get().count() == 1 and models.get("weave-3").count() == 3
    assert models.delete("weave-2") and not models.delete("weave-2")
    with pytest.raises(KeyError):
        models.get("weave-2")


def test_exact_rule_stops_at_the_ends(spark):
    from loomspark.operators import exact

    points = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 1.2, 0.5, 0.5), (2, 0.5, 0.5, 0.76), (3, 0.0, 0.5, 0.5), (4, 0.5, 0.6, 0.5)], "vid long, x double, y double, z double")
    found = {r.vid: r for r in exact.point_information(points, fixtures.square_yarn(spark)).collect()}
    assert [found[i].yarn_id for i in range(5)] == [0, -1, -1, 0, 0]
    assert found[4].distance == pytest.approx(-0.14) and found[4].u == pytest.approx(-0.1)


def test_clipping_keeps_winding(spark):
    from loomspark.operators import clip

    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0), (1, 3.0, 0.0, 0.0, 4.0, 0.0, 0.0, 3.0, 1.0, 0.0), (2, -3.0, 0.0, 0.0, -2.0, 0.0, 0.0, -3.0, 1.0, 0.0)], "tri_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    kept = clip.clip_triangles(rows, (1, 0, 0), 1.0).collect()
    signed = lambda r: ((r.x1 - r.x0) * (r.y2 - r.y0) - (r.x2 - r.x0) * (r.y1 - r.y0)) / 2
    assert {r.tri_id for r in kept} == {0, 1}
    assert all(signed(r) > 0 for r in kept)
    assert sum(signed(r) for r in kept if r.tri_id == 0) == pytest.approx(0.5)
    other = clip.clip_triangles(rows, (-1, 0, 0), -1.0).collect()
    assert sum(signed(r) for r in other if r.tri_id == 0) == pytest.approx(1.5)


def test_entry_imports_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "loomspark", tmp_path / "loomspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q); print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0
