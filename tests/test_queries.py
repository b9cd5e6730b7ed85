"""Registered queries against their SQL twins at the smallest scale."""

import pytest
from harness import compare, duck

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [
    "admit_labels", "label_lines", "unit_permitted", "item_sequence", "route_product_match", "flatten_payloads", "payload_flags",
    "startrack_evidence", "detect_mode_and_variant", "lines_from_items", "sscc_checks", "service_matrix_payload", "identity_gate", "stored_audit",
    "enriched_facts", "rules_startrack", "house_rules", "stream_totals",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    ok, message, n = compare(__spark_entry__.queries()[name](spark, SF), duck(SF), __spark_entry__.oracle_sql()[name])
    assert ok and n, message
