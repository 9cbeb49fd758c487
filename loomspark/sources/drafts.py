"""Path files and weave drafts: text whose lines mean what the block they stand in says.

Readers take numbered lines (``decks.read_lines``). Which block a line is in and its place there are running counts
over the file, so nothing loops over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that a draft's option lines begin with (fixed by the format).
OPTIONS = ("FIBRE_COUNT", "LINEAR_DENSITY", "FIBRE_DIAMETER", "FIBRE_DENSITY", "WIDTH", "WEFT_DENSITY", "TOW_AREA", "WEFT_REPEAT", "ORTHOGONAL", "TOW_WIDTH", "TOW_HEIGHT", "BINDER_WIDTH", "BINDER_HEIGHT")


def _blocks(lines: DataFrame) -> DataFrame:
    """Data lines of a path file: section (VECTORS until another is named), block (comments above), n (in the file), pos (in the block)."""
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    comment = F.col("value").startswith("*")
    name = F.regexp_extract("value", r"^\[([A-Z]+)\]", 1)
    marked = lines.select("file", "line_no", "value", F.sum(comment.cast("int")).over(upto).alias("block"), F.coalesce(F.last(F.when(name != "", name), ignorenulls=True).over(upto), F.lit("VECTORS")).alias("section"))
    data = marked.where(~comment & (F.trim("value") != "") & ~F.col("value").rlike(r"^( |\[[A-Z]+\])"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    pos = F.row_number().over(Window.partitionBy("file", "section", "block").orderBy("line_no"))
    return data.withColumn("n", n).withColumn("pos", pos)


def _numbers(column: str) -> str:
    return f"transform(split({column}, ','), v -> try_cast(trim(v) AS DOUBLE))"


def parse_paths(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lattices, nodes, section points and domains of path files.

    lattice(file, l1, l2, d1x, d1y, d2x, d2y); node(file, yarn_id, section_id, node_idx, x, y, z, ux, uy, uz), a yarn for
    each chain: the origin of its first vector and the end of each; section_point(file, section_id, pt_idx, x, y);
    domain(file, lo_x ... hi_z). A vector is the lines between two comments: the vector itself, its chain, a count of
    slave nodes, and the slaves, of which the last names the section (the vector's own number if there is none).
    Up vectors are (0, 0, 1) where a line has none. A file without lines gives no rows.
    """
    data = _blocks(lines)
    head = data.where("section = 'VECTORS' AND n = 3").selectExpr("file", f"{_numbers('value')} AS v")
    lattice = head.selectExpr("file", *(f"v[{i}] AS {c}" for i, c in enumerate(("l1", "l2", "d1x", "d1y", "d2x", "d2y"))))
    grouped = data.where("section = 'VECTORS' AND n > 3").groupBy("file", "block").agg(
        F.min("line_no").alias("at"),
        F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("vector"),
        F.max(F.when(F.col("pos") == 2, F.col("value"))).alias("chain"),
        F.max_by(F.when(F.col("pos") > 3, F.col("value")), F.when(F.col("pos") > 3, F.col("pos"))).alias("slave"),
    )
    vectors = grouped.where("chain IS NOT NULL").selectExpr("file", "at", f"{_numbers('vector')} AS v", f"{_numbers('chain')} AS c", f"{_numbers('slave')} AS s")
    up = lambda k: ", ".join(f"'u{c}', CASE WHEN size(v) >= 14 THEN v[{8 + 3 * k + i}] ELSE {float(i == 2)}D END" for i, c in enumerate("xyz"))
    point = lambda k: ", ".join(f"'{c}', v[{2 + 3 * k + i}]" for i, c in enumerate("xyz"))
    order = Window.partitionBy("file", "yarn_id").orderBy("at")
    chained = vectors.selectExpr("file", "at", "CAST(c[0] AS INT) AS yarn_id", "CAST(coalesce(s[5], v[0]) AS INT) AS section_id", f"named_struct({point(0)}, {up(0)}) AS origin", f"named_struct({point(1)}, {up(1)}) AS target")
    chained = chained.withColumn("k", F.row_number().over(order)).withColumn("section_id", F.first("section_id").over(order))
    ends = chained.select("file", "yarn_id", "section_id", F.explode(F.expr("CASE WHEN k = 1 THEN array(named_struct('i', 0, 'p', origin), named_struct('i', 1, 'p', target)) ELSE array(named_struct('i', k, 'p', target)) END")).alias("n"))
    nodes = ends.select("file", "yarn_id", "section_id", F.col("n.i").alias("node_idx"), "n.p.*")
    rows = data.where("section = 'SECTIONS'")
    header = F.when(F.col("pos") == 1, F.expr("CAST(trim(split(substring(value, instr(value, '\t') + 1), ',')[0]) AS INT)"))
    owned = rows.withColumn("section_id", F.first(header, ignorenulls=True).over(Window.partitionBy("file", "block")))
    points = owned.where("pos > 1").selectExpr("file", "section_id", "CAST(pos - 2 AS INT) AS pt_idx", f"{_numbers('value')} AS v").selectExpr("file", "section_id", "pt_idx", "v[1] AS x", "v[2] AS y")
    limits = data.where("section = 'DOMAIN'").selectExpr("file", f"{_numbers('value')} AS v")
    domain = limits.selectExpr("file", *(f"v[{i}] AS {c}" for i, c in enumerate(("lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z"))))
    return lattice, nodes, points, domain


def parse_points(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (file, x, y, z, alpha), yarn types (file, type_no, name, shape) and points of textile files with nine lines to a point.

    point(file, yarn_id, pt_idx, type_no, x, y, z, width, height, ux, uy, uz, tx, ty, tz). The head is the cell, its
    angle, the number of types, six lines for each and a count of sections; a yarn is its type, a count, its points and
    a line with an asterisk. Where a line stands in its yarn tells its meaning; a record that breaks off is left out.
    """
    number = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    rows = lines.withColumn("n", number)
    head = rows.where("n <= 3").groupBy("file").agg(*(F.max(F.when(F.col("n") == k, F.col("value"))).alias(c) for k, c in ((1, "cell"), (2, "alpha"), (3, "types"))))
    head = head.selectExpr("file", "transform(split(trim(cell), ' +'), v -> CAST(v AS DOUBLE)) AS v", "CAST(trim(alpha) AS DOUBLE) AS alpha", "CAST(trim(types) AS INT) AS types")
    rows = rows.join(head.select("file", "types"), "file")
    kinds = rows.where("n > 3 AND n <= 3 + 6 * types").groupBy("file", F.expr("(n - 4) div 6").alias("k")).agg(*(F.max(F.when((F.col("n") - 4) % 6 == i, F.trim("value"))).alias(c) for i, c in enumerate(("type_no", "name", "shape"))))
    types = kinds.selectExpr("file", "CAST(type_no AS INT) AS type_no", "name", "shape")
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    body = rows.where("n > 4 + 6 * types AND trim(value) != ''").withColumn("star", F.trim("value") == "*").withColumn("yarn_id", F.sum(F.col("star").cast("int")).over(upto)).where("NOT star")
    body = body.withColumn("r", F.row_number().over(Window.partitionBy("file", "yarn_id").orderBy("n")) - 1)
    kind = body.where("r = 0").selectExpr("file", "yarn_id", "CAST(trim(value) AS INT) AS type_no")
    fields = body.where("r >= 2").groupBy("file", "yarn_id", F.expr("CAST((r - 2) div 9 AS INT)").alias("pt_idx")).agg(F.count("*").alias("size"), *(F.max(F.when((F.col("r") - 2) % 9 == i, F.expr("transform(split(trim(value), ' +'), v -> CAST(v AS DOUBLE))"))).alias(c) for i, c in ((0, "p"), (2, "d"), (5, "u"), (6, "t"))))
    place = [f"{a}[{i}] AS {'' if a == 'p' else a}{c}" for a in "put" for i, c in enumerate("xyz")]
    points = fields.where("size = 9").join(kind, ["file", "yarn_id"]).selectExpr("file", "CAST(yarn_id AS INT) AS yarn_id", "pt_idx", "type_no", *place[:3], "d[0] AS width", "d[1] AS height", *place[3:])
    return head.selectExpr("file", "v[0] AS x", "v[1] AS y", "v[2] AS z", "alpha"), types, points


def parse_draft(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layers (file, warp, yarns), cells (file, weft, warp, level) and options (file, keyword, number, unit) of weave drafts.

    The first line has the size of each warp stack; each further line of digits alone is a weft, a digit for each warp.
    A line that mixes digits and other words, or begins with an unknown word, is left out.
    """
    first = Window.partitionBy("file").orderBy("line_no")
    numbered = lines.where("trim(value) != ''").withColumn("n", F.row_number().over(first))
    layers = numbered.where("n = 1").select("file", F.posexplode(F.expr(r"filter(split(trim(value), '\\s+'), v -> v RLIKE '^[0-9]+$')")).alias("warp", "v")).selectExpr("file", "warp", "CAST(v AS INT) AS yarns")
    digits = numbered.where(r"n > 1 AND value RLIKE '^[0-9\\s]+$'").withColumn("weft", F.row_number().over(first) - 1)
    cells = digits.select("file", "weft", F.posexplode(F.expr(r"split(regexp_replace(value, '\\s', ''), '')")).alias("warp", "v")).where("v != ''").selectExpr("file", "weft", "warp", "CAST(v AS INT) AS level")
    words = numbered.where("n > 1").selectExpr("file", r"split(trim(value), '\\s+') AS w").where(F.expr("w[0]").isin(*OPTIONS))
    options = words.selectExpr("file", "w[0] AS keyword", "CASE WHEN size(w) > 1 THEN try_cast(w[1] AS DOUBLE) END AS number", "CASE WHEN size(w) > 2 THEN w[2] END AS unit")
    return layers, cells, options


def draft_lines(heddles: DataFrame, pattern: DataFrame, chain: DataFrame, n_heddles: int) -> DataFrame:
    """(line_no, value) of a draft: the heddles from the last to the first, each beside its place in a straight
    tie-up, two empty lines, and each row of the pattern beside its row of the chain draft.

    heddles(warp, heddle) from 0, pattern(row, cells) and chain(row, cells), cells as text of ones and noughts.
    """
    bits = heddles.select("warp", F.posexplode(F.expr(f"transform(sequence(0, {n_heddles - 1}), h -> CASE WHEN h = heddle THEN '1' ELSE '0' END)")).alias("h", "bit"))
    rows = bits.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("warp", "bit"))), lambda s: s["bit"]), "").alias("cells"))
    tie = F.expr(f"concat(repeat('0', h), '1', repeat('0', {n_heddles - 1} - h))")
    top = rows.select((F.lit(n_heddles - 1) - F.col("h")).cast("long").alias("line_no"), F.concat("cells", F.lit("\t"), tie).alias("value"))
    gap = heddles.sparkSession.range(2).select((F.col("id") + n_heddles).alias("line_no"), F.lit("").alias("value"))
    right = chain.select("row", F.col("cells").alias("chained"))
    low = pattern.join(right, "row").select((F.col("row") + n_heddles + 2).cast("long").alias("line_no"), F.concat("cells", F.lit("\t"), "chained").alias("value"))
    return top.unionByName(gap).unionByName(low)
