"""The registered queries' columns, the license query's SQL, and the pipeline stage by stage."""

import re

import pytest

import corpus_pipeline
from loomspark.llm import language, packing, quality, queries, secrets

COLUMNS = {
    "op1_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_language": "doc_id held_out lang_pred score",
    "op5_quality": "doc_id held_out score predicted",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_digest": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next class_id copies",
    "op8_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_training_order": "slot shard byte_offset first_doc_id first_start n_bytes crc32",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name not in ("op6_packing", "op10_training_order"):
        assert len(rows) == 200


def test_licenses_as_sql(spark, sf_dir, duck, rows_of):
    df = queries.queries()["op9_licenses"](spark, sf_dir)
    cursor = duck.execute(queries.oracle_sql()["op9_licenses"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
        seen.append(({r.doc_id: r for r in docs.collect()}, after.collect()))
        docs = after
    before, after = seen[0]
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import numpy as np

    good = {i for i, r in before.items() if model.scores(np.array([quality.vector(r.text)]))[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in after} == good and 0 < len(good) < len(before)
    before, after = seen[1]
    known = language.fit(spark.createDataFrame(list(before.values())))
    want = {i for i, r in before.items() if known.predict(r.text)[0] != "und" and known.predict(r.text)[1] >= corpus_pipeline.LEAST_LANGUAGE}
    assert {r.doc_id for r in after} == want
    before, after = seen[2]
    kept = {r.doc_id for r in after}
    sets = {i: shingles(r.text) for i, r in before.items()}
    for i in before:
        near = [j for j in before if j != i and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])]
        assert i not in kept or all(j > i for j in near)
        if i not in kept:
            assert any(len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) for j in before if j != i)
    before, after = seen[3]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert len(r.text) == r.n_chars and not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)
        if r.text != before[r.doc_id].text:
            assert "[SECRET]" in r.text
    before, after = seen[4]
    read = packing.IdReader()
    sums = {}
    for r in after:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == {i: len(read(r.text)) + 1 for i, r in before.items()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)
    assert secrets.KINDS[3] == "random"
