"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, full case folding, NFKC again, every run of white space as one space and none
at the ends. Its fingerprint is 128 bits of xxhash64 with two seeds. Texts are grouped by fingerprint and
within it byte by byte, so a chance collision of fingerprints joins no different texts.

Normalisation and folding are functions of the ICU library that Spark ships, called through the SQL function
``reflect``; texts in ASCII, which they leave as they are but for case, take ``lower``.

Null texts are empty ones; white space alone is canonically empty. Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents

#: Rows to a bucket of neighbouring ids, and the most buckets; beyond, buckets grow.
BUCKET_ROWS, MAX_BUCKETS, PER_LIST = 2048, 1 << 16, 256


def canonical(text: str) -> Column:
    """Of the SQL expression ``text``."""
    nfkc = "reflect('com.ibm.icu.text.Normalizer', 'compose', {}, true)"
    folded = nfkc.format(f"reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {nfkc.format(text)}, true)")
    cased = f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE {folded} END"
    return F.expr(rf"trim(regexp_replace({cased}, '[\\p{{IsWhite_Space}}]+', ' '))")


def fingerprint(form: str | Column) -> Column:
    """32 hex digits of a canonical form."""
    c = F.col(form) if isinstance(form, str) else form
    part = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(part(F.xxhash64(c)), part(F.xxhash64(F.lit("second seed"), c)))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds ``out``; a column of that name is replaced."""
    return df.withColumn("_form", canonical(f"coalesce({text}, '')")).withColumn(out, fingerprint("_form")).drop("_form")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """fingerprint, octets, check, class_id, copies: one row for each different canonical text.

    Grouping by the form itself compares bytes inside equal buckets; copies fold on the map side, so a
    hot text is one row for each task.
    """
    forms = df.select(F.col(doc_id).alias("doc_id"), canonical(f"coalesce({text}, '')").alias("form"))
    grouped = forms.select("doc_id", fingerprint("form").alias("fingerprint"), "form").groupBy("fingerprint", "form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return grouped.select("fingerprint", F.octet_length("form").alias("octets"), F.sha2("form", 256).alias("check"), "class_id", "copies")


def buckets(df: DataFrame, doc_id: str, rows: int = BUCKET_ROWS) -> Column:
    """A column that cuts the ids into ranges of about ``rows`` rows; the limits are at most ``MAX_BUCKETS`` numbers."""
    n = df.count()
    wanted = max(1, min(MAX_BUCKETS, -(-n // rows)))
    if wanted == 1:
        return F.lit(0)
    limits = sorted(set(df.approxQuantile(doc_id, [i / wanted for i in range(1, wanted)], 0.25 / wanted)))
    limits = sorted({int(x) for x in limits})
    lists = [limits[i : i + PER_LIST] for i in range(0, len(limits), PER_LIST)]
    array = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    if len(lists) == 1:
        return F.expr(f"size(filter({array(lists[0])}, x -> x <= {doc_id}))")
    upper, whole = array([x[0] for x in lists]), f"array({', '.join(map(array, lists))})"
    at = f"greatest(1, size(filter({upper}, x -> x <= {doc_id})))"
    return F.expr(f"({at} - 1) * {PER_LIST} + size(filter(element_at({whole}, {at}), x -> x <= {doc_id}))")


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and next_text: that of the next document by id, and for the last one of the first.

    Ids are cut into ranges; a range's rows are sorted in one task, with the first row of the range behind added.
    So each text is shuffled once, and no task sees more than a range. Of repeated ids the
    texts are in order of their bytes.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucketed = rows.withColumn("bucket", buckets(rows, "doc_id"))
    heads = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("head"))
    # a row for each range: at most MAX_BUCKETS, so one task orders them and every executor can hold them
    from pyspark.sql import Window

    order = Window.orderBy("bucket")
    before = heads.select("head", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("bucket"))
    added = rows.join(F.broadcast(before), F.col("doc_id") == F.col("head")).select("doc_id", "text", "bucket", F.lit(1).alias("added"))
    both = bucketed.withColumn("added", F.lit(0)).select("doc_id", "text", "bucket", "added").unionByName(added)
    w = Window.partitionBy("bucket").orderBy("added", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(w)).where("added = 0").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def op7_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = with_next(docs)
    rows = rows.withColumn("n", F.char_length("text"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, n - n div 2), left(next_text, CAST(n div 2 AS INT)))"))
    rows = rows.withColumn("form", canonical("text")).withColumn("edited_form", canonical("edited"))
    rows = rows.withColumn("near_next", F.when(F.col("text") == F.col("next_text"), 1.0).otherwise((canonical("next_text") == F.col("form")).cast("double")))
    found = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("form").alias("fingerprint"),
        fingerprint("edited_form").alias("edited_fingerprint"),
        (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"),
        "near_next",
        F.octet_length("form").alias("octets"),
        F.sha2("form", 256).alias("check"),
    )
    return found.join(classes(docs), ["fingerprint", "octets", "check"], "left").drop("octets", "check")
