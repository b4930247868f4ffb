"""Functions for SQL text, registered in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# a value is written bare or as {"value": ...}; an object without a value of its own gives null
FUNCTIONS = (
    "extraction_payload_value(payload STRING, field STRING) RETURNS STRING RETURN CASE WHEN get_json_object(payload, concat('$.', field)) LIKE '{%' THEN get_json_object(payload, concat('$.', field, '.value')) ELSE get_json_object(payload, concat('$.', field)) END",
    "audit_text(value STRING) RETURNS STRING RETURN nullif(trim(value), '')",
)


def register(spark: SparkSession, actor: str) -> None:
    """extraction_payload_value, audit_text and current_audit_actor as temporary functions; actor: who acts in this session."""
    if not actor.strip():
        raise ValueError("an actor needs a name")
    for function in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")
    name = actor.strip().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION current_audit_actor() RETURNS STRING RETURN '{name}'")
