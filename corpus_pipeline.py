"""A training corpus from raw documents: five stages, each over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import language, packing, quality, secrets, simhash
from loomspark.llm.common import documents, labels, remove_dir, shared_dir

#: Scores under this aren't told from a tie between languages.
LEAST_LANGUAGE = 0.4


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, labels(spark, sf_dir))
    return quality.filter_rows(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is told from the others."""
    return language.filter_rows(docs, language.fit(docs), least=LEAST_LANGUAGE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return _like(docs, simhash.keep_one(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark."""
    return _like(docs, secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good),
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: The classifiers and tokenizers aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is removed when the next one is written; that of the last but one is what the result reads."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        folder = shared_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_dir(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
