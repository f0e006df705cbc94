"""Schemas of the stored tables, and additive migration to them."""

from __future__ import annotations

from pyspark.sql.types import StructType

def _table(columns: str) -> StructType:
    """A schema from ``name type`` pairs; type names are those of Spark's JSON form, so no session is needed."""
    out = StructType()
    for column in columns.split(", "):
        out = out.add(*column.split(" "))
    return out


PERSONS = _table("id long, name string, doc string, sex string, age integer, created_at timestamp_ntz, birth_date string, weight_kg double, height_cm double, bp string, hr integer, notes string")
PERSON_DOCS = _table("person_id long, doc string")
REPORTS = _table("id long, person_id long, source_file string, stored_path string, file_hash string, lab string, date timestamp_ntz, date_text string, order_code string, doctor string, age integer, sex string, notes string, is_document boolean, ingested_at timestamp_ntz")
TESTS = _table("id long, report_id long, section string, name string, canonical string, value double, raw_result string, unit string, ref_low double, ref_high double, ref_text string, flag string, qual string, method string")
MEDS = _table("id long, person_id long, name string, dose string, frequency string, notes string, added_at timestamp_ntz")
DOCUMENTS = _table("id long, person_id long, orig_filename string, stored_path string, kind string, size long, study_date string, notes string, file_hash string, uploaded_at timestamp_ntz")
ANALYSES = _table("id long, document_id long, kind string, status string, model string, text string, findings_json string, error string, created_at timestamp_ntz")
AI_REPORTS = _table("id long, person_id long, model_key string, model_label string, content string, generated_at timestamp_ntz")
FILES = _table("path string, sha1 string, size long, mtime double, ingested_at timestamp_ntz")
