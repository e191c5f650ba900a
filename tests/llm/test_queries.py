import pytest
from oracle_check import duck, rows_of

import __spark_entry__

COLUMNS = {
    "op1_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_sharding": "doc_id slot shard",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_divergence": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_decontamination": "doc_id item_id n_hits n_equal",
    "op8_classifier": "doc_id held_out score predicted",
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op10_huffman": "doc_id start n_tokens ids_crc32",
    "op13_winnowing": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}
KINDS = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "base_score": "double", "fingerprint": "string", "kept_sha256": "string", "predicted": "int", "kept": "boolean", "base_failed": "boolean", "slot": "int", "shard": "string", "n_equal": "int", "n_hits": "bigint", "edited_sha256": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    df = __spark_entry__.queries()[name](spark, sf)
    kinds = dict(df.dtypes)
    for column in COLUMNS[name].split():
        assert kinds[column] == KINDS.get(column, "bigint"), column
    got = df.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if name not in ("op3_packing", "op7_decontamination"):
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sql = __spark_entry__.oracle_sql().get(name)
    assert (sql is not None) == (name in ("op2_sharding", "op6_divergence", "op7_decontamination", "op9_substring_dedup"))
    if sql:
        found = duck(sf).execute(sql)
        columns = [d[0] for d in found.description]
        assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(columns, found.fetchall())


def test_source_divergence(spark, sf):
    df = __spark_entry__.queries()["op12_prefixes"](spark, sf)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = duck(sf).execute(__spark_entry__.oracle_sql()["op12_prefixes"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in found.description], found.fetchall())


def test_native_queries_run_no_python(spark, sf):
    for name in ("op2_sharding", "op6_divergence", "op7_decontamination"):
        plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
