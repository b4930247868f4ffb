"""Which verified records count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_authority() -> Column:
    """An approved extraction that is not of a batch, or of an active financial one."""
    legacy = F.col("batch_id").isNull()
    return (F.col("status") == "approved") & (legacy | ((F.col("lifecycle") == "active") & (F.col("record_kind") == "financial")))


def with_batch(extracted: DataFrame, batches: DataFrame) -> DataFrame:
    return extracted.join(batches, extracted["batch_id"] == batches["active_batch_id"], "left")


def active(verified: DataFrame, extracted: DataFrame, batches: DataFrame) -> DataFrame:
    """Verified records with authority; filters on the extraction side run before the joins."""
    approved = with_batch(extracted.where("status = 'approved'"), batches).where(has_authority())
    keys = (verified["extracted_id"] == approved["extraction_id"]) & (verified["document_id"] == approved["extraction_document_id"])
    return verified.join(approved, keys, "left_semi")
