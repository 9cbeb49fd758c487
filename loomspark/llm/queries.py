"""The queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from loomspark.llm import bpe, digest, language, licenses, packing, quality, secrets, simhash, training_order, webp


def queries():
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_secrets": secrets.op2_secrets,
        "op3_simhash": simhash.op3_simhash,
        "op4_language": language.op4_language,
        "op5_quality": quality.op5_quality,
        "op6_packing": packing.op6_packing,
        "op7_digest": digest.op7_digest,
        "op8_webp": webp.op8_webp,
        "op9_licenses": licenses.op9_licenses,
        "op10_training_order": training_order.op10_training_order,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op9_licenses": licenses.ORACLE}
