import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_extract": "page_id url text n_chars", "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op3_decontam": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_langid": "doc_id held_out lang_pred score", "op5_repeats": "doc_id n_bytes n_removed n_spans kept_sha256", "op6_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_quality": "doc_id held_out score predicted", "op8_mixing": "doc_id size source_size target taken", "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op10_jaccard": "doc_id n_shingles component_id",
    "op11_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12_simhash": "doc_id fingerprint component_id", "op13_align": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, compare, name):
    from lexspark.llm import queries

    query, sql = queries.queries()[name], queries.oracle_sql().get(name)
    df = query(spark, SF)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    table, key = {"op1_extract": ("pages", "page_id"), "op11_repair": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    keys = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in (keys.distinct() if key == "conv_id" else keys).collect())
    if sql:
        got, want = compare(spark, query, sql, SF)
        assert got == want


def test_held_out_accuracy(spark):
    from lexspark.llm import queries

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lang = queries.queries()["op4_langid"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in lang) >= 0.98 * len(lang)
    good = queries.queries()["op7_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.quality == r.predicted for r in good) >= 0.97 * len(good)


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near copies", "decontamination", "mixing", "sharding"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:4]:
        assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns)
    out = p.run(spark, SF).collect()
    assert out and {r.shard for r in out} <= set(range(40))
