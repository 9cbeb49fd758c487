"""Measures, choices and small rules over yarns, weaves, element sets and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ten colours that an index stands for, red, green and blue
PALETTE = (
    (1.0, 0.0, 0.0),
    (0.0, 1.0, 0.0),
    (0.0, 0.0, 1.0),
    (1.0, 1.0, 0.0),
    (0.0, 1.0, 1.0),
    (1.0, 0.0, 1.0),
    (1.0, 0.0, 0.5),
    (0.0, 0.5, 1.0),
    (1.0, 0.5, 0.0),
    (0.5, 1.0, 0.0),
)
#: Volume fractions outside 0 to this are suspect.
LIKELY = 0.86


# Along a yarn and up a cell


def mid_values(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``mid``: the mean of a section's value and the one before; null for the first."""
    return rows.withColumn("mid", (F.col(value) + F.lag(value).over(Window.partitionBy(key).orderBy(order))) / 2)


def stacked(rows: DataFrame, cell: str | list[str], order: str, height: str) -> DataFrame:
    """Adds ``bottom`` and ``top`` of each level in a cell that are put on each other."""
    cells = [cell] if isinstance(cell, str) else cell
    so_far = F.sum(height).over(Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("top", so_far).withColumn("bottom", F.col("top") - F.col(height))


def bracketing(positions: str, at: str) -> dict[str, Column]:
    """``below`` and ``above``: places in the ordered array ``positions`` of the last one up to ``at`` and the first one from it on,
    and ``share``, how far ``at`` is from one to the other. The yarn repeats: before the first comes the last less 1, behind the last the first and 1."""
    low = f"size(filter({positions}, p -> p <= {at})) - 1"
    high = f"size(filter({positions}, p -> p < {at}))"
    n = f"size({positions})"
    below, above = f"CASE WHEN {low} < 0 THEN {n} - 1 ELSE {low} END", f"CASE WHEN {high} >= {n} THEN 0 ELSE {high} END"
    start = f"({positions}[{below}] - CASE WHEN {low} < 0 THEN 1 ELSE 0 END)"
    end = f"({positions}[{above}] + CASE WHEN {high} >= {n} THEN 1 ELSE 0 END)"
    share = f"CASE WHEN {start} = {end} THEN 0D ELSE ({at} - {start}) / ({end} - {start}) END"
    return {"below": F.expr(below), "above": F.expr(above), "share": F.expr(share)}


def ends_match(nodes: DataFrame, repeats: DataFrame, key: str = "yarn_id", order: str = "node_idx", tolerance: float = 1e-6) -> DataFrame:
    """(key, matches): whether a yarn's last node is its first one moved by its repeat (rx, ry, rz), forth or back."""
    at = F.struct("x", "y", "z")
    ends = nodes.groupBy(key).agg(F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b")).join(repeats, key)
    apart = lambda sign: F.sqrt(sum((F.col(f"b.{c}") - F.col(f"a.{c}") - sign * F.col(f"r{c}")) ** 2 for c in "xyz")) < tolerance
    return ends.select(key, (apart(1) | apart(-1)).alias("matches"))


# Sums over a textile


def with_fallback(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with each column that is null or 0 taken from ``other``, the textile's own properties."""
    general = other.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(general, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def yarn_properties(yarns: DataFrame) -> DataFrame:
    """Adds volume, fibre_volume and fraction of yarns (length, section_area, fibre_area), and the forms per area of the repeat (repeat_area; null if that is 0)."""
    rows = yarns.withColumn("volume", F.col("length") * F.col("section_area")).withColumn("fibre_volume", F.col("length") * F.col("fibre_area"))
    rows = rows.withColumn("fraction", F.col("fibre_area") / F.nullif(F.col("section_area"), F.lit(0)))
    return rows.withColumns({f"{c}_per_area": F.col(c) / F.nullif(F.col("repeat_area"), F.lit(0)) for c in ("length", "volume", "fibre_volume")})


def textile_totals(yarns: DataFrame, key: str = "textile_id") -> DataFrame:
    """(key, length, volume, fibre_volume and each per area): sums over a textile's yarns; per area 0 if any yarn's repeat has no area."""
    rows = yarn_properties(yarns)
    sums = [F.sum(c).alias(c) for c in ("length", "volume", "fibre_volume")]
    areas = [F.when(F.min("repeat_area") == 0, 0.0).otherwise(F.sum(f"{c}_per_area")).alias(f"{c}_per_area") for c in ("length", "volume", "fibre_volume")]
    return rows.groupBy(key).agg(*sums, *areas)


def domain_fraction(yarns: DataFrame, domains: DataFrame, key: str = "textile_id") -> DataFrame:
    """(key, fraction): fibre in the domain's volume, each yarn (fraction, volume within the domain) by its mean fraction."""
    return yarns.groupBy(key).agg(F.sum(F.col("fraction") * F.col("volume")).alias("fibre")).join(domains.select(key, F.col("volume").alias("whole")), key).select(key, (F.col("fibre") / F.col("whole")).alias("fraction"))


def constants(strains: DataFrame, key: str = "model_id") -> DataFrame:
    """Elastic constants from mean strains under six unit stresses (key, load 1 to 6 for 11, 22, 33, 12, 13, 23; e11 ... e23)."""
    at = lambda load, c: F.max(F.when(F.col("load") == load, F.col(c)))
    whole = lambda load, c: F.nullif(at(load, c), F.lit(0))
    young = [(1 / whole(i, f"e{i}{i}")).alias(f"E{i}") for i in (1, 2, 3)]
    poisson = [(-at(i, f"e{j}{j}") / whole(i, f"e{i}{i}")).alias(f"nu{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3) if i != j]
    shear = [(1 / whole(load, f"e{p}")).alias(f"G{p}") for load, p in ((4, "12"), (5, "13"), (6, "23"))]
    return strains.groupBy(key).agg(*young, *poisson, *shear)


def widths(yarns: DataFrame, cells: DataFrame, key: str = "textile_id") -> DataFrame:
    """(key, mean, widest, layers): of yarns (key, width), and the most yarns (key, x, y, level) in a cell."""
    most = cells.groupBy(key, "x", "y").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("layers"))
    return yarns.groupBy(key).agg(F.avg("width").alias("mean"), F.max("width").alias("widest")).join(most, key, "left")


def run_summary(runs: DataFrame, key: str, seconds: str, wall: float | None = None) -> DataFrame:
    """(key, runs, fastest, mean, slowest, a_second): throughput over the wall time, or over the sum of all runs without one."""
    total = F.lit(wall) if wall is not None else F.sum(seconds)
    return runs.groupBy(key).agg(F.count(seconds).alias("runs"), F.min(seconds).alias("fastest"), F.avg(seconds).alias("mean"), F.max(seconds).alias("slowest"), (F.count(seconds) / F.nullif(total, F.lit(0))).alias("a_second"))


# Choices


def least(rows: DataFrame, group: list[str], by: str, *names: str) -> DataFrame:
    """The row of each group with the least ``by``; of equal ones that with the least ``names`` in order."""
    return rows.groupBy(*group).agg(F.min(F.struct(by, *names)).alias("m")).select(*group, *(f"m.{n}" for n in names))


def in_order(rows: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """(group, ids): a region's yarns from low to high; of equal heights the smaller id first."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(by, name))).alias("s")).select(group, F.col(f"s.{name}").alias("ids"))


def contact_pairs(touching: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b: each pair of different yarns once."""
    return touching.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def valid_patterns(cells: DataFrame, key: str = "textile_id") -> DataFrame:
    """(key, valid): whether all cells (x, y, kind ``X`` or ``Y``, a row a yarn) of a row hold as many X yarns, and all of a column as many Y yarns."""
    counts = cells.groupBy(key, "x", "y").agg(F.count_if(F.col("kind") == "X").alias("nx"), F.count_if(F.col("kind") == "Y").alias("ny"))
    rows = counts.groupBy(key, F.col("y").alias("place")).agg(F.count_distinct("nx").alias("n"))
    columns = counts.groupBy(key, F.col("x").alias("place")).agg(F.count_distinct("ny").alias("n"))
    return rows.unionAll(columns).groupBy(key).agg((F.max("n") == 1).alias("valid"))


def of_types(elements: DataFrame, *types: str, keep: bool = True) -> DataFrame:
    """The elements of these types, or all others."""
    return elements.where(F.col("type").isin(*types) if keep else ~F.col("type").isin(*types))


def set_members(sets: DataFrame, wanted: str) -> DataFrame:
    """The distinct elem_id of sets (set_name, elem_id): of ``auto`` those whose name has ``yarn`` in it, else of the set of this very
    name, else, if there is none, of all that have it in their names; the case doesn't matter in names' parts."""
    if wanted.lower() == "auto":
        return sets.where(F.lower("set_name").contains("yarn")).select("elem_id").distinct()
    rows = sets.where(F.lower("set_name").contains(wanted.lower())).withColumn("same", F.col("set_name") == wanted)
    members = rows.groupBy("elem_id").agg(F.max("same").alias("same"))
    # one number for all, read once: whether a set has the very name
    exact = rows.agg(F.coalesce(F.max("same"), F.lit(False)).alias("exact"))
    return members.join(F.broadcast(exact), F.col("same") | ~F.col("exact")).select("elem_id")


def on_boundary(point: tuple[str, str, str], lo: tuple, hi: tuple, tolerance: str = "1e-9") -> Column:
    """Whether a point lies in one of a box's six faces."""
    return F.expr(" OR ".join(f"abs({c} - ({b})) <= {tolerance}" for c, ends in zip(point, zip(lo, hi, strict=True), strict=True) for b in ends))


# Domains


def box_limits(planes: DataFrame, key: str = "domain_id") -> DataFrame:
    """(key, lox ... hiz) of domains of six planes (key, nx, ny, nz, d) that are a box: n . p >= d inside; other domains are left out."""
    facing = lambda i, sign: sum(((F.col(f"n{c}") == (sign if k == i else 0)).cast("int") for k, c in enumerate("xyz")), F.lit(0)) == 3
    low = [F.max(F.when(facing(i, 1), F.col("d"))).alias(f"lo{c}") for i, c in enumerate("xyz")]
    high = [F.max(F.when(facing(i, -1), -F.col("d"))).alias(f"hi{c}") for i, c in enumerate("xyz")]
    limits = planes.groupBy(key).agg(F.count("*").alias("n"), *low, *high)
    return limits.where("n = 6").drop("n").dropna()


def hull_nodes(planes: DataFrame, key: str = "domain_id", tolerance: float = 1e-9) -> DataFrame:
    """(key, x, y, z): corners of convex domains - points where three planes (key, plane_id, nx, ny, nz, d) meet that all planes hold.

    A domain has a handful of planes, so three of each are joined by its key. Equal corners are one, to a billionth.
    """
    from loomspark.functions import vec

    named = lambda p: planes.select(key, F.col("plane_id").alias(f"{p}_id"), *(F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"), F.col("d").alias(f"{p}d"))
    three = named("a").join(named("m"), key).where("a_id < m_id").join(named("c"), key).where("m_id < c_id")
    a, b, c = (vec.vec(p) for p in "amc")
    det = vec.determinant((a, b, c))
    met = three.withColumn("det", F.expr(det)).where("abs(det) > 1e-12")
    sums = vec.add(vec.scale(vec.cross(b, c), "ad"), vec.add(vec.scale(vec.cross(c, a), "md"), vec.scale(vec.cross(a, b), "cd")))
    met = met.select(key, *(F.expr(f"{e} / det").alias(n) for e, n in zip(sums, "xyz", strict=True)))
    corners = met.select(key, *(F.round(n, 9).alias(n) for n in "xyz")).distinct()
    held = corners.join(planes, key).groupBy(key, "x", "y", "z").agg(F.min(F.expr("nx * x + ny * y + nz * z - d")).alias("least"))
    return held.where(F.col("least") >= -max(tolerance, 2e-9)).select(key, "x", "y", "z")


def meets_box(nodes: DataFrame, key: str, lo: tuple, hi: tuple, tolerance: float = 0.0) -> DataFrame:
    """(key, meets): whether the box round each mesh's nodes (key, x, y, z) and the domain's box have a point in common."""
    limits = nodes.groupBy(key).agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"))
    within = " AND ".join(f"lo{c} <= {h!r} + {tolerance!r} AND hi{c} >= {low!r} - {tolerance!r}" for c, low, h in zip("xyz", lo, hi, strict=True))
    return limits.select(key, F.expr(within).alias("meets"))


def overlaps_cell(item: tuple[str, str, str], reach: str, lo: tuple[str, str, str], hi: tuple[str, str, str]) -> str:
    """SQL: whether a node within ``reach`` of its place can lie in an octree's cell."""
    return "(" + " AND ".join(f"{p} + {reach} >= {a} AND {p} - {reach} <= {b}" for p, a, b in zip(item, lo, hi, strict=True)) + ")"


# Rules of one value


def colour(index: str) -> Column:
    """The colour of an index, as struct<r, g, b>; indices go round."""
    every = ", ".join(f"named_struct('r', {r}D, 'g', {g}D, 'b', {b}D)" for r, g, b in PALETTE)
    return F.expr(f"array({every})[CAST(pmod({index}, {len(PALETTE)}) AS INT)]")


def fibre_area(area: str, count: str, diameter: str, linear_density: str, density: str) -> Column:
    """The area that is given, else that of ``count`` round fibres, else linear density by density, else 0; 0 counts as not given."""
    given = lambda *names: " AND ".join(f"coalesce({n}, 0) != 0" for n in names)
    return F.expr(
        f"CASE WHEN {given(area)} THEN {area} WHEN {given(count, diameter)} THEN {count} * pi() * {diameter} * {diameter} / 4 "
        f"WHEN {given(linear_density, density)} THEN {linear_density} / {density} ELSE 0D END"
    )


def fraction(fibre: str, section: str) -> Column:
    """struct<value, suspect> of a constant distribution."""
    value = f"({fibre} / nullif({section}, 0))"
    return F.expr(f"named_struct('value', {value}, 'suspect', {value} < 0 OR {value} > {LIKELY})")


def fraction_at(fibre: str, ring: str, drop_off: str, x: str) -> Column:
    """Of a quadratic distribution at ``x`` in the section ``ring``: the mean kept, at the widest place ``drop_off`` times that of the middle."""
    from loomspark.functions import polygons

    widest = f"array_max(transform({ring}, p -> abs(p.x)))"
    area, second = polygons.area(ring), polygons.moments(ring)
    # the middle's value times (drop_off + (1 - drop_off) (1 - x x / w w)), integrated over the section, is the fibres' area
    middle = f"({fibre} / abs({area} - (1 - {drop_off}) * {second} / pow({widest}, 2)))"
    return F.expr(f"{middle} * ({drop_off} + (1 - {drop_off}) * (1 - pow({x} / {widest}, 2)))")


def node_at(n: str, t: str) -> dict[str, Column]:
    """``segment`` and ``share`` of the place ``t`` (0 to 1) on a path of ``n`` nodes; the end belongs to the last segment."""
    past = f"CAST({t} * ({n} - 1) AS INT) >= {n} - 1"
    return {"segment": F.expr(f"CASE WHEN {past} THEN {n} - 2 ELSE CAST({t} * ({n} - 1) AS INT) END"), "share": F.expr(f"CASE WHEN {past} THEN 1D ELSE {t} * ({n} - 1) - CAST({t} * ({n} - 1) AS INT) END")}


def up_at(a: tuple[str, str, str], b: tuple[str, str, str], t: str) -> tuple[str, str, str]:
    """SQL of the direction upwards between two nodes, of length one; a node without one has +z."""
    from loomspark.functions import vec

    whole = lambda v: tuple(f"CASE WHEN {vec.dot(v, v)} = 0 THEN {d} ELSE {c} END" for c, d in zip(v, ("0D", "0D", "1D"), strict=True))
    return vec.normalise(vec.path_linear(whole(a), whole(b), t))


def triangle_plane(a: tuple[str, str, str], b: tuple[str, str, str], c: tuple[str, str, str]) -> tuple[tuple[str, str, str], str]:
    """SQL of the normal (length one, by the order of the corners) and distance from the origin of a triangle's plane; null without an area."""
    from loomspark.functions import vec

    n = vec.normalise(vec.cross(vec.sub(b, a), vec.sub(c, a)))
    return n, vec.dot(n, a)


def file_name(path: str, extension: str | None = None) -> Column:
    """A path's last part with spaces as underscores, without its extension or with another one."""
    bare = f"regexp_replace(regexp_replace({path}, '^.*[/\\\\\\\\]', ''), '[.][^.]*$', '')"
    return F.expr(f"concat(replace({bare}, ' ', '_'), '{extension or ''}')")


def wrapped(values: str, most: int = 16) -> Column:
    """Lines of at most ``most`` values of an array, with commas between; none for an empty one."""
    return F.expr(f"CASE WHEN size({values}) > 0 THEN transform(sequence(0, (size({values}) - 1) div {most}), i -> array_join(transform(slice({values}, i * {most} + 1, {most}), v -> CAST(v AS STRING)), ', ')) ELSE CAST(array() AS array<string>) END")


def closest_within(points: str, x: str, y: str, most: str) -> Column:
    """The place in an array of (x, y) of the nearest point to (x, y), the first of equal ones, or -1 if its squared distance is over ``most``."""
    near = f"array_min(transform({points}, (p, i) -> named_struct('d', pow(p.x - {x}, 2) + pow(p.y - {y}, 2), 'i', i)))"
    return F.expr(f"CASE WHEN {near}.d <= {most} THEN {near}.i ELSE -1 END")
