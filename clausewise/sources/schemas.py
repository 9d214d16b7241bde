"""Schemas of the tables, and making those that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table -> columns in SQL's words.
SCHEMAS = {
    "biz_source_documents": "id bigint, file_name string, title string, content_text string, content_hash string, category string, created_at timestamp_ntz",
    "kb_document": "id bigint, title string, doc_type string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "kb_chunk": "id bigint, document_id bigint, chunk_no int, section_no string, section_title string, subsection_no string, subsection_title string, content string, page_no int, created_at timestamp_ntz",
    "biz_legal_knowledge": "id bigint, source_doc_id bigint, knowledge_type string, name string, description string, golden_quote string, domain string, is_indexed boolean, content_hash string",
    "biz_risk_assessments": "id bigint, event_summary string, risk_level string, total_score int, full_report_md string, created_at timestamp_ntz",
    "biz_business_type": "id bigint, type_code string, type_name string, parent_id bigint, description string, status int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "biz_policy_document": "id bigint, doc_code string, doc_name string, doc_category string, version_no string, issuing_dept string, effective_date date, expiry_date date, status int, source_doc_id bigint, source_uri string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "biz_policy_clause": "id bigint, policy_doc_id bigint, clause_no string, clause_title string, clause_text string, page_no int, anchor_code string, content_hash string, status int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "biz_business_clause_map": "id bigint, business_type_id bigint, clause_id bigint, mandatory_level int, relevance_weight double, trigger_keywords string, remark string, status int, created_at timestamp_ntz",
    "biz_procedure_step": "id bigint, business_type_id bigint, step_no int, step_name string, step_desc string, responsible_role string, due_rule string, output_deliverable string, clause_id bigint, status int, created_at timestamp_ntz",
    "biz_required_material": "id bigint, business_type_id bigint, material_code string, material_name string, required_level int, format_rule string, validator_rule string, clause_id bigint, status int, created_at timestamp_ntz",
    "biz_compliance_task": "id bigint, task_no string, input_mode string, input_text string, uploaded_doc_id bigint, applicant_id string, applicant_dept string, model_version string, overall_score double, compliance_status string, risk_level string, status int, created_at timestamp_ntz, completed_at timestamp_ntz",
    "biz_task_type_hit": "id bigint, task_id bigint, business_type_id bigint, confidence double, evidence_text string, created_at timestamp_ntz",
    "biz_task_gap": "id bigint, task_id bigint, gap_type string, gap_item string, expected_req string, detected_content string, severity int, fix_suggestion string, clause_id bigint, trace_link string, created_at timestamp_ntz",
}


def ensure_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, created): makes the tables of SCHEMAS that the catalog does not have yet, as Parquet."""
    out = []
    for name, columns in SCHEMAS.items():
        missing = not spark.catalog.tableExists(f"{database}.{name}")
        if missing:
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet")
        out.append((name, missing))
    return spark.createDataFrame(out, "table string, created boolean")
