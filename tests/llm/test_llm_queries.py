"""The queries of the training-data operators against their SQL, and their columns."""

from __future__ import annotations

import pytest
from comparing import SF_DIR, duck_lines, spark_lines

from eventloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    1: "query_id rank vec_id score", 2: "doc_id start n_tokens ids_crc32", 3: "doc_id size source_size target taken", 4: "page_id url text n_chars",
    5: "doc_id piece start length ids_crc32 sequence_id offset", 6: "doc_id held_out score predicted", 7: "doc_id n_shingles component_id",
    8: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 9: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", 12: "query_id rank vec_id score",
    13: "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert spark_lines(QUERIES[name](spark, SF_DIR)) == duck_lines(SF_DIR, ORACLE_SQL[name])


def test_names_and_columns(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    for name, make in QUERIES.items():
        if want := COLUMNS.get(int(name[2:].split("_")[0])):
            assert set(want.split()) <= set(make(spark, "/root/testdata/sf0.001").columns), name
