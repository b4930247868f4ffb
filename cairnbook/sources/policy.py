"""What happens to a file that comes in: an ordered table of decisions over its detected format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons by family of content, reasons that refuse a file, reasons after which a retry can help, tabular kinds.
FAMILY_REASONS = {
    "empty": "empty_file", "audio": "prohibited_audio", "video": "prohibited_video", "executable": "prohibited_executable", "active": "active_content", "encrypted": "encrypted_content",
    "ambiguous": "inspection_ambiguous", "malformed": "malformed_content",
}
REFUSALS = (
    "invalid_host", "empty_file", "request_too_large", "multipart_limit_exceeded", "json_limit_exceeded", "upload_capacity_exceeded", "upload_too_large", "prohibited_audio", "prohibited_video", "prohibited_executable",
    "active_content", "encrypted_content", "inspection_ambiguous", "malformed_content", "resource_limit_exceeded", "idempotency_conflict", "internal_error", "intake_intent_mismatch",
)
RETRYABLE = (
    "model_unavailable", "processing_failed", "adapter_unavailable", "decoder_unavailable", "opaque_safe_fallback", "upload_capacity_exceeded", "internal_error", "sandbox_unavailable", "worker_capability_stale",
    "registry_mismatch", "generic_candidate_deferred",
)
TABULAR_FAMILIES, TABULAR_FORMATS = ("table", "tabular", "spreadsheet"), ("csv", "tsv", "xlsx", "xls", "ods")


def decide(files: DataFrame, process: Column) -> DataFrame:
    """files (family, format, evidence: array, intent, violation) with action, reason and retryable.

    process: array of formats that the running registry parses.  The first rule that holds decides: a violation, a risk found in the
    content, a refused family, a bill scan that is no image or PDF, an archive that cannot be parsed, tables of a generic
    file (to be mapped), its scans (deferred), what can be parsed, and what is only kept.
    """
    family, fmt, intent = F.col("family"), F.col("format"), F.coalesce("intent", F.lit("legacy_unspecified"))
    risks = F.transform("evidence", lambda e: F.regexp_replace(e, "^risk:", ""))
    risk = F.try_element_at(F.filter(risks, lambda r: r.isin(*REFUSALS)), F.lit(1))
    refused = F.coalesce("violation", risk, F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILY_REASONS.items() for x in kv]), family))
    parsed = F.array_contains(process, fmt)
    tabular = family.isin(*TABULAR_FAMILIES) | fmt.isin(*TABULAR_FORMATS)
    scan = (family == "image") | (fmt == "pdf")
    generic = intent == "generic_file"

    def said(action, reason):
        return F.struct(F.lit(action).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    kept = F.when(family == "image", "decoder_unavailable").when(family == "opaque", "opaque_safe_fallback").otherwise("adapter_unavailable")
    verdict = (
        F.when(refused.isNotNull(), said("reject", refused)).when((intent == "bill_scan") & ~scan, said("reject", "intake_intent_mismatch")).when((family == "container") & ~parsed, said("reject", "inspection_ambiguous"))
        .when(generic & tabular, said("process", "mapping_required")).when(generic & scan & ~parsed, said("store_unprocessed", "generic_candidate_deferred")).when(parsed, said("process", "processing_queued")).otherwise(said("store_unprocessed", kept))
    )
    return files.withColumn("verdict_", verdict).select("*", "verdict_.action", "verdict_.reason", F.col("verdict_.reason").isin(*RETRYABLE).alias("retryable")).drop("verdict_")


def within(rows: DataFrame, content: str, ceilings: dict[str, tuple[Column, int]]) -> DataFrame:
    """rows with error: the first measure above its ceiling, and then nothing of the content (null); null without content or excess.

    ceilings: name -> (measure, highest value).  Measures are taken on the whole content, in the scan.
    """
    over = [F.when(measure > most, F.concat(F.lit(f"{name}: "), measure.cast("string"), F.lit(f" is above {most}"))) for name, (measure, most) in ceilings.items()]
    return rows.withColumn("error", F.coalesce(*over)).withColumn(content, F.when(F.col("error").isNull(), F.col(content)))


FAMILIES = {
    "csv": "table", "tsv": "table", "json": "structured", "jsonl": "structured", "yaml": "structured", "xml": "structured", "svg": "structured", "html": "markup", "md": "markup", "text": "text", "log": "text", "rst": "text",
    "docx": "document", "pptx": "document", "odf": "document", "rtf": "document", "pdf": "document", "eml": "mail", "xlsx": "spreadsheet", "zip": "container", "tar": "container", "gzip": "container",
    "png": "image", "jpeg": "image", "gif": "image", "tiff": "image", "bmp": "image", "unknown": "opaque",
}


def family(fmt: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), fmt), F.lit("opaque"))
