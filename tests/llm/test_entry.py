"""Registration: names, schemas of contracts, and the SQL."""

import pytest

import __spark_entry__
from colsql.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_pieces": "doc_id n_pieces ids_crc32",
    "op4_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_langid": "doc_id held_out lang_pred score",
    "op8_token_counts": "doc_id n_words n_tokens",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


def test_names():
    assert set(COLUMNS) | {"pipeline"} == set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries()) and set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(queries.queries()[name](spark, SF).columns)
