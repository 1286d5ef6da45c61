"""What an extraction envelope holds: its type, its payload, and the short forms that callers get."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_type(given: Column, record: Column) -> Column:
    """The type that is given, else classification.document_type, else document_type."""
    return F.coalesce(given, F.try_variant_get(record, "$.classification.document_type", "string"), F.try_variant_get(record, "$.document_type", "string"))


def resolve_payload(record: Column) -> Column:
    """structured_data if the key is there, even as null, else the whole record."""
    data = F.try_variant_get(record, "$.structured_data", "variant")
    return F.when(data.isNotNull(), data).otherwise(record)


def results_projection(record: Column) -> Column:
    """(document_type, structured_data, confidence, detected_language) of an envelope; one without structured data, as a failed one, has none to show."""
    get = lambda path, kind="string": F.try_variant_get(record, path, kind)
    return F.struct(F.coalesce(get("$.classification.document_type"), F.lit("other")).alias("document_type"), F.nullif(F.to_json(get("$.structured_data", "variant")), F.lit("null")).alias("structured_data"), get("$.comprehensive_confidence.overall_confidence", "double").alias("confidence"), F.coalesce(get("$.metadata.detected_language"), F.lit("Unknown")).alias("detected_language"))


def response_projection(record: Column) -> Column:
    """(status, document_type, overall_confidence, language, seconds) of an envelope."""
    get = lambda path, kind="string": F.try_variant_get(record, path, kind)
    return F.struct(get("$.status").alias("status"), get("$.classification.document_type").alias("document_type"), get("$.comprehensive_confidence.overall_confidence", "double").alias("overall_confidence"), get("$.metadata.detected_language").alias("language"), get("$.metadata.processing_time_seconds", "double").alias("seconds"))
