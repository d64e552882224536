"""The registered queries by name; those with SQL against it."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_quality": "doc_id",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_nearest": "query_id rank vec_id score",
    "op6_near_duplicates": "doc_id n_shingles component_id kept",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9_language": "doc_id held_out lang_pred score",
    "op10_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_query(spark, name):
    df = entry.queries()[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert rows
    if sql := entry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert rows == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
