"""Which yarn owns each point: a bucketed range join, then an arg-min.

Yarn images have a conservative box. Space is cut into a lattice of buckets; a box is listed under every bucket
it touches and a point under its own, so the range join is an equi-join that Catalyst can broadcast when
the images are few and shuffle when they aren't. The box test, a part of the rule and not only of the
speed, follows; then the nearest node of the path, local coordinates and the point-in-section test, within one row
per point and image. The winner is the least (distance, yarn, image), which settles ties like a scan in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import polygons
from loomspark.operators.plan import settle

#: Buckets along each axis of the images' extent.
BUCKETS = 16
#: Rows of boxes under buckets, about 80 bytes each, that are sent to every task at most.
MOST_LISTED = 500_000


def images(yarns: DataFrame) -> DataFrame:
    """One row for each translation of a yarn: its nodes in place and the box that can hold its points.

    yarns: yarn_id, nodes array<struct<x, y, z, tx, ty, tz, ux, uy, uz, sx, sy, sz>> (position, tangent, up, side),
    section array<struct<x, y>>, translations array<struct<x, y, z>>.
    """
    reach = """sqrt(array_max(transform(section, p -> p.x * p.x + p.y * p.y)))
        + coalesce(array_max(transform(sequence(1, size(nodes) - 1), i -> sqrt(pow(nodes[i].x - nodes[i - 1].x, 2) + pow(nodes[i].y - nodes[i - 1].y, 2) + pow(nodes[i].z - nodes[i - 1].z, 2)))), 0D) / 2 + 1e-6D"""
    rows = yarns.withColumn("reach", F.expr(f"CASE WHEN size(nodes) > 1 THEN {reach} ELSE sqrt(array_max(transform(section, p -> p.x * p.x + p.y * p.y))) + 1e-6D END"))
    rows = rows.select("yarn_id", "nodes", "section", "reach", F.posexplode("translations").alias("image", "t"))
    moved = "transform(nodes, n -> named_struct('x', n.x + t.x, 'y', n.y + t.y, 'z', n.z + t.z, 'tx', n.tx, 'ty', n.ty, 'tz', n.tz, 'ux', n.ux, 'uy', n.uy, 'uz', n.uz, 'sx', n.sx, 'sy', n.sy, 'sz', n.sz))"
    rows = rows.withColumn("nodes", F.expr(moved))
    box = [F.expr(f"array_{f}(transform(nodes, n -> n.{c})) {s} reach").alias(f"{k}{c}") for k, f, s in (("lo", "min", "-"), ("hi", "max", "+")) for c in "xyz"]
    return rows.select("yarn_id", "image", "nodes", "section", *box)


def _bucketed(points: DataFrame, found: DataFrame, lo, hi) -> tuple[DataFrame, DataFrame]:
    size = [max((b - a) / BUCKETS, 1e-12) for a, b in zip(lo, hi, strict=True)]
    cell = lambda e, k: f"CAST(least({BUCKETS - 1}, greatest(0, floor(({e} - {lo[k]!r}D) / {size[k]!r}D))) AS INT)"
    number = lambda a, b, c: f"{a} + {BUCKETS} * ({b} + {BUCKETS} * {c})"
    points = points.withColumn("bucket", F.expr(number(*(cell(c, k) for k, c in enumerate("xyz")))))
    ranges = [f"sequence({cell(f'lo{c}', k)}, {cell(f'hi{c}', k)})" for k, c in enumerate("xyz")]
    every = f"flatten(transform({ranges[0]}, i -> flatten(transform({ranges[1]}, j -> transform({ranges[2]}, k -> {number('i', 'j', 'k')})))))"
    return points, found.withColumn("bucket", F.explode(F.expr(every)))


def classify(points: DataFrame, yarns: DataFrame, key: str = "vid", extent=((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), pruning: bool = True) -> DataFrame:
    """``points`` (key, x, y, z) with yarn_id, -1 where no yarn holds the point, and distance.

    ``extent`` only shapes the buckets; points and boxes outside fall into those at its border.
    Without ``pruning`` the box test is left out, and points beyond a yarn's ends may belong to it.
    """
    found = images(yarns)
    few = _few(found)
    paths = found.select("yarn_id", "image", "nodes", "section")
    if pruning:
        # boxes alone are listed under buckets, paths are brought to those that are met
        at, boxes = _bucketed(points, found.select("yarn_id", "image", *(f"{e}{c}" for e in ("lo", "hi") for c in "xyz")), *extent)
        met = at.select(key, "x", "y", "z", "bucket").join(F.broadcast(boxes) if few and boxes.count() <= MOST_LISTED else boxes, "bucket")
        met = met.where("x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz").select(key, "x", "y", "z", "yarn_id", "image")
        met = met.join(F.broadcast(paths) if few else paths, ["yarn_id", "image"])
    else:
        # the rule itself compares every point with every yarn here
        met = points.select(key, "x", "y", "z").join(F.broadcast(paths) if few else paths)
    near = "array_min(transform(nodes, (n, i) -> named_struct('d', pow(x - n.x, 2) + pow(y - n.y, 2) + pow(z - n.z, 2), 'i', i)))"
    met = settle(met.select(key, "x", "y", "z", "yarn_id", "image", "nodes", "section"), near=F.expr(near))
    met = settle(met, n=F.expr("nodes[near.i]"))
    local = lambda c: f"((x - n.x) * n.{c}x + (y - n.y) * n.{c}y + (z - n.z) * n.{c}z)"
    met = settle(met, u=F.expr(local("s")), v=F.expr(local("u")), distance=F.expr(f"sqrt(near.d) + abs({local('t')}) * 0.1D")).select(key, "yarn_id", "image", "section", "u", "v", "distance")
    inside = met.where(F.expr(polygons.inside_half_open("section", "u", "v")))
    best = inside.groupBy(key).agg(F.min(F.struct("distance", "yarn_id", "image")).alias("best"))
    return points.join(best, key, "left").withColumn("yarn_id", F.coalesce("best.yarn_id", F.lit(-1))).withColumn("distance", F.col("best.distance")).drop("best")


def _few(found: DataFrame, most_nodes: int = 100_000) -> bool:
    """Whether the images are small enough to be sent to every task: a count of their nodes, about 120 bytes each.

    Beyond, both sides are shuffled by bucket."""
    return (found.agg(F.sum(F.size("nodes") + F.size("section"))).first()[0] or 0) <= most_nodes


def voxelize(yarns: DataFrame, nx: int, ny: int, nz: int, lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0), pruning: bool = True) -> DataFrame:
    """The cells of a grid with the yarn at their centre."""
    from loomspark.sources.grids import centres

    return classify(centres(yarns.sparkSession, (nx, ny, nz), lo, hi), yarns, "vid", (lo, hi), pruning)


def refine(yarns: DataFrame, shape: tuple[int, int, int], levels: int, lo=(0.0, 0.0, 0.0), hi=(1.0, 1.0, 1.0), most: int = 10_000_000) -> DataFrame:
    """Cells split in eight wherever centre and corners belong to different yarns, up to ``levels`` times.

    Each level is a classification of nine samples a cell; cells are written to the checkpoint folder between levels.
    More than ``most`` cells are an error.
    """
    from loomspark.sources.grids import lows

    if levels < 0:
        raise ValueError("levels can't be negative")
    spark = yarns.sparkSession
    front = lows(spark, shape, lo, hi).withColumn("path", F.col("vid").cast("string"))
    done = None
    inset = 1e-9
    for level in range(levels + 1):
        sample = [(0.5, 0.5, 0.5)] + [(a, b, c) for a in (inset, 1 - inset) for b in (inset, 1 - inset) for c in (inset, 1 - inset)]
        spots = F.array(*(F.struct(F.lit(i).alias("i"), *(F.expr(f"{c} + d{c} * {f!r}D").alias(c) for c, f in zip("xyz", s, strict=True))) for i, s in enumerate(sample)))
        points = front.select("path", F.explode(spots).alias("s")).select(F.concat_ws("#", "path", "s.i").alias("vid"), "path", F.col("s.i").alias("i"), "s.x", "s.y", "s.z")
        owner = classify(points, yarns, "vid", (lo, hi)).groupBy("path").agg(F.count_distinct("yarn_id").alias("kinds"), F.max(F.when(F.col("i") == 0, F.col("yarn_id"))).alias("yarn_id"))
        front = front.join(owner, "path").checkpoint()
        kept = front if level == levels else front.where("kinds = 1")
        kept = kept.select("path", "x", "y", "z", "dx", "dy", "dz", "level", "yarn_id")
        done = kept if done is None else done.unionByName(kept)
        if level == levels:
            break
        halves = F.array(*(F.struct(F.lit(i).alias("i"), *(F.expr(f"{c} + d{c} * {0.5 * (i >> k & 1)}D").alias(c) for k, c in enumerate("xyz"))) for i in range(8)))
        front = front.where("kinds > 1").select("path", "dx", "dy", "dz", "level", F.explode(halves).alias("h")).select(F.concat_ws(".", "path", "h.i").alias("path"), "h.x", "h.y", "h.z", *(F.expr(f"d{c} / 2").alias(f"d{c}") for c in "xyz"), (F.col("level") + 1).cast("smallint").alias("level"))
    if done.count() > most:
        raise ValueError(f"refinement gives more than {most} cells")
    return done


def element_sets(voxels: DataFrame, key: str = "vid") -> DataFrame:
    """(set_name, elem_id): numbered from 1, matrix cells under ``Matrix``."""
    return voxels.select(F.when(F.col("yarn_id") < 0, "Matrix").otherwise(F.concat(F.lit("Yarn"), F.col("yarn_id"))).alias("set_name"), (F.col(key) + 1).alias("elem_id"))
