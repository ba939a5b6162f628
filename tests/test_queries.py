"""The registered queries against DuckDB on the smallest tables (all of them: python checks/compare.py SF_DIR)."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
PICKED = ["scan_documents", "scan_pages", "hits_table_notes", "detect_us_ssn", "detect_iban_code", "resolve_overlaps_memos",
          "mask_documents", "pseudonymize_notes", "pseudonymize_keyed", "policy_ai_prompt", "policy_per_row",
          "policy_block_rates", "preflight_notes", "sanitize_nested", "column_profile", "profile_servicenow_itsm",
          "field_hint_by_row", "metrics", "read_csv", "read_json_array", "stream_sanitize", "stream_late_drop"]


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    ok, n, m, note = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    assert n > 0


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "sanitized_text", "hit_count", "entity_types", "risk_level"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sanitize_nested", "metrics", "sql_functions", "sql_table_function", "column_profile", "exclude_drop",
                                  "process_record_recursive", "sanitize_variant", "variant_policy", "audit_policy", "audit_preflight", "preflight_gate", "sanitize_record_policy",
                                  "nested_policy_skip", "sanitize_json_unknown_keys", "scan_paged_conversations", "policy_per_row", "report_file"])
def test_one_detection_per_row(spark, name):
    """The optimized plan runs a pattern in one place only."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?iU)\bHS[-_]\d{4}[-_]\d{3,6}\b, 0)") == 1, plan[:2000]
