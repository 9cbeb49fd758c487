"""Finite-element decks and other text formats: parsers over numbered lines, and their writers.

A file is read whole and its lines numbered, as a line's meaning depends on the keyword above; that is a running
last value, not a loop. Writers give numbered lines; ``write_lines`` puts them in one file in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(path)


def sections(lines: DataFrame) -> DataFrame:
    """Data lines with the keyword line they stand under; comments and empty lines go."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_key = F.col("value").rlike(r"^\*[^*]")
    marked = lines.where("value NOT LIKE '**%' AND trim(value) != ''").withColumn("keyword", F.last(F.when(is_key, F.lower(F.trim("value"))), ignorenulls=True).over(w))
    return marked.where(~is_key)


def parse_deck(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node_id, x, y, z), elements (elem_id, nodes) and sets (set_name, elem_id) of a deck's lines.

    A line that ends in a comma goes on in the next; GENERATE stands for a range with a step.
    """
    data = sections(lines)
    numbers = F.expr("transform(filter(split(value, ','), v -> trim(v) != ''), v -> CAST(trim(v) AS DOUBLE))")
    nodes = data.where("keyword LIKE '*node%'").select(numbers.alias("v")).selectExpr("CAST(v[0] AS BIGINT) AS node_id", "v[1] AS x", "v[2] AS y", "v[3] AS z")
    w = Window.partitionBy("file").orderBy("line_no")
    rows = data.where("keyword LIKE '*element,%' OR keyword = '*element'").withColumn("goes_on", F.trim("value").endswith(","))
    rows = rows.withColumn("starts", (~F.coalesce(F.lag("goes_on").over(w), F.lit(False))).cast("int")).withColumn("record", F.sum("starts").over(w))
    joined = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("parts"))
    ids = F.expr("transform(filter(split(array_join(transform(parts, p -> p.value), ','), ','), v -> trim(v) != ''), v -> CAST(trim(v) AS BIGINT))")
    elements = joined.select(ids.alias("v")).selectExpr("v[0] AS elem_id", "slice(v, 2, size(v) - 1) AS nodes")
    members = data.where("keyword LIKE '*elset%'").select(F.regexp_extract("keyword", r"elset=([^,]+)", 1).alias("set_name"), F.col("keyword").contains("generate").alias("ranges"), F.expr("transform(filter(split(value, ','), v -> trim(v) != ''), v -> CAST(trim(v) AS BIGINT))").alias("v"))
    sets = members.select("set_name", F.explode(F.expr("CASE WHEN ranges THEN sequence(v[0], v[1], CASE WHEN size(v) > 2 THEN v[2] ELSE 1L END) ELSE v END")).alias("elem_id"))
    return nodes, elements, sets


#: Ids to a line of a set.
PER_LINE = 16


def set_lines(sets: DataFrame, per_line: int = PER_LINE) -> DataFrame:
    """(set_name, line, value): the members of each set in order, so many to a line."""
    w = Window.partitionBy("set_name").orderBy("elem_id")
    rows = sets.withColumn("line", F.expr(f"(row_number - 1) div {per_line}") if "row_number" in sets.columns else ((F.row_number().over(w) - 1) / per_line).cast("int"))
    return rows.groupBy("set_name", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list("elem_id")), lambda i: i.cast("string")), ", ").alias("value"))


def deck_lines(nodes: DataFrame, elements: DataFrame, sets: DataFrame, kind: str = "C3D8R") -> DataFrame:
    """(line_no, value) of a deck. Numbers leave gaps; only their order counts."""
    block = lambda k, n: F.lit(k << 56) + n
    spark = nodes.sparkSession
    heads = spark.createDataFrame([(0 << 56, "*Node"), (1 << 56, f"*Element, Type={kind}")], "line_no long, value string")
    of_nodes = nodes.select(block(0, F.col("node_id") + 1).alias("line_no"), F.format_string("%d, %.12e, %.12e, %.12e", "node_id", "x", "y", "z").alias("value"))
    of_elements = elements.select(block(1, F.col("elem_id") + 1).alias("line_no"), F.concat(F.col("elem_id").cast("string"), F.lit(", "), F.array_join(F.transform("nodes", lambda i: i.cast("string")), ", ")).alias("value"))
    numbered = set_lines(sets)
    place = F.dense_rank().over(Window.orderBy("set_name"))
    names = sets.select("set_name").distinct().withColumn("s", place)
    rows = numbered.join(names, "set_name").select(block(2, F.col("s").cast("long") * (1 << 40) + F.col("line") + 1).alias("line_no"), "value")
    heads_of_sets = names.select(block(2, F.col("s").cast("long") * (1 << 40)).alias("line_no"), F.concat(F.lit("*ElSet, ElSet="), "set_name").alias("value"))
    return heads.unionByName(of_nodes).unionByName(of_elements).unionByName(heads_of_sets).unionByName(rows)


def parse_displacements(lines: DataFrame) -> DataFrame:
    """(node_id, u1, u2, u3) of a nodal table: the rows of four numbers behind a header that begins with NODE."""
    data = sections(lines.withColumn("value", F.when(F.col("value").rlike(r"^\s*NODE\b"), F.lit("*node table")).otherwise(F.col("value"))))
    row = F.regexp_extract_all(F.col("value"), F.lit(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"), F.lit(0))
    return data.where("keyword = '*node table'").select(row.alias("v")).where("size(v) = 4").selectExpr("CAST(v[0] AS BIGINT) AS node_id", *(f"CAST(v[{i}] AS DOUBLE) AS u{i}" for i in (1, 2, 3)))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Master nodes of a model's XML: (textile, yarn_id, node_idx, x, y, z); a row for each ``Textile`` is read."""
    schema = "_name STRING, Yarn ARRAY<STRUCT<_index: INT, MasterNode: ARRAY<STRUCT<_Position: STRING>>>>"
    rows = spark.read.format("xml").option("rowTag", "Textile").schema(schema).load(path)
    nodes = rows.select(F.col("_name").alias("textile"), F.explode("Yarn").alias("y")).select("textile", F.col("y._index").alias("yarn_id"), F.posexplode("y.MasterNode").alias("node_idx", "n"))
    return nodes.select("textile", "yarn_id", "node_idx", *(F.expr(f"CAST(trim(split(n._Position, ',')[{k}]) AS DOUBLE)").alias(c) for k, c in enumerate("xyz")))


def write_model(nodes: DataFrame, path: str) -> None:
    """The same XML from (textile, yarn_id, node_idx, x, y, z)."""
    place = F.format_string("%.12e, %.12e, %.12e", "x", "y", "z")
    yarns = nodes.groupBy("textile", "yarn_id").agg(F.array_sort(F.collect_list(F.struct("node_idx", place.alias("p")))).alias("n"))
    rows = yarns.groupBy("textile").agg(F.array_sort(F.collect_list(F.struct(F.col("yarn_id").alias("_index"), F.expr("transform(n, p -> named_struct('_Position', p.p))").alias("MasterNode")))).alias("Yarn"))
    rows.withColumnRenamed("textile", "_name").coalesce(1).write.mode("overwrite").format("xml").option("rootTag", "Model").option("rowTag", "Textile").save(path)
