"""Completeness, quality and consistency of records of any registered type, kept as VARIANT.

A missing key, a JSON null and a blank text are told apart: each rule has its own idea of presence. Every rule is an expression
compiled from the registry on the driver, so a table of records is scored without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.values import confidence_grade, parse_date_flexible
from folioq.functions.variants import at, filled, text_of, walk
from folioq.registry import REQUIRED, SCHEMAS

#: Weights of the overall score, and the confidence of a field.
WEIGHTS = {"completeness": 0.35, "data_quality": 0.25, "field_confidence": 0.20, "consistency": 0.15, "ocr_quality": 0.05}
FIELD_CONFIDENCE = 0.9


def text_at(record: Column, path: str) -> Column:
    """The value as text; null for a missing key and for JSON null."""
    return F.try_variant_get(record, "$." + path, "string")


def has_key(record: Column, path: str) -> Column:
    return at(record, path).isNotNull()


def has_value(record: Column, path: str) -> Column:
    """Present and not null; blank texts count."""
    return text_at(record, path).isNotNull()


def has_content(record: Column, path: str) -> Column:
    """Present, not null and not blank; an empty list counts."""
    return F.coalesce(F.btrim(text_at(record, path)) != "", F.lit(False))


def by_type(kind: Column, of: Callable[[str], Column], unknown: Column) -> Column:
    """of(type) for the registered types, in whatever case the type is written."""
    low = F.lower(kind)
    return reduce(lambda out, t: out.when(low == t, of(t)), list(SCHEMAS)[1:], F.when(low == next(iter(SCHEMAS)), of(next(iter(SCHEMAS))))).otherwise(unknown)


def total(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def validate_required(kind: Column, record: Column) -> Column:
    """Messages for required fields whose key is missing; none for unknown types."""
    return by_type(kind, lambda t: F.array_compact(F.array(*[F.when(~has_key(record, p), f"Missing required field: {p}") for p in REQUIRED[t]])), F.array().cast("array<string>"))


def required_ratio(kind: Column, record: Column, present: Callable[[Column, str], Column], unknown: float) -> Column:
    return by_type(kind, lambda t: total([present(record, p) for p in REQUIRED[t]]) / len(REQUIRED[t]), F.lit(unknown))


def extraction_confidence(kind: Column, record: Column) -> Column:
    """Share of required fields with a value, two decimals; 0 for unknown types."""
    return F.round(required_ratio(kind, record, has_value, 0.0), 2)


def schema_completeness(kind: Column, record: Column) -> Column:
    """Share of required fields with content; 1 for unknown types."""
    return required_ratio(kind, record, has_content, 1.0)


def leaf_counts(record: Column) -> Column:
    """(n_leaves, n_valid) of a record as it is, registered or not: a list is one leaf, valid if it isn't empty."""
    flags = F.transform(walk(record), lambda e: filled(e["value"]))
    counted = F.transform(F.array(flags), lambda x: F.struct(F.size(x).alias("n_leaves"), F.size(F.filter(x, lambda f: f)).alias("n_valid")))
    return F.element_at(counted, 1)


def data_quality(record: Column) -> Column:
    """Share of valid leaves; 0 for a record without any."""
    return F.element_at(F.transform(F.array(leaf_counts(record)), lambda c: F.coalesce(F.try_divide(c["n_valid"], c["n_leaves"]), F.lit(0.0))), 1)


def consistency_invoice(record: Column) -> Column:
    """0 if a positive subtotal is off the sum of the line totals by more than a cent, else 1; needs both keys."""
    lines = F.coalesce(F.try_variant_get(record, "$.line_items", "array<struct<total: double>>"), F.array())
    stated = F.coalesce(F.try_variant_get(record, "$.subtotal", "double"), F.lit(0.0))
    summed = F.aggregate(lines, F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0)))
    off = has_key(record, "line_items") & has_key(record, "subtotal") & (stated > 0) & (F.abs(summed - stated) > 0.01)
    return F.when(off, 0.0).otherwise(1.0)


def consistency_resume(record: Column) -> Column:
    """Share of jobs that don't end before they start; 1 without jobs."""
    jobs = F.coalesce(F.try_variant_get(record, "$.experience", "array<struct<start_date: string, end_date: string>>"), F.array())
    wrong = F.filter(jobs, lambda j: F.coalesce(parse_date_flexible(j["start_date"]) > parse_date_flexible(j["end_date"]), F.lit(False)))
    return F.when(F.size(jobs) > 0, 1 - F.size(wrong) / F.size(jobs)).otherwise(1.0)


def consistency_contract(record: Column) -> Column:
    """0 if the contract takes effect after it expires, else 1; needs both keys."""
    late = parse_date_flexible(text_at(record, "effective_date")) > parse_date_flexible(text_at(record, "expiration_date"))
    return F.when(F.coalesce(late, F.lit(False)), 0.0).otherwise(1.0)


def consistency(kind: Column, record: Column) -> Column:
    low = F.lower(kind)
    return F.when(low == "invoice", consistency_invoice(record)).when(low == "resume", consistency_resume(record)).when(low == "contract", consistency_contract(record)).otherwise(1.0)


def comprehensive_score(records: DataFrame, kind: str = "document_type", record: str = "record", ocr: str | None = None) -> DataFrame:
    """records with completeness, data_quality, field_confidence, consistency, ocr_quality, overall (three decimals) and grade.

    ocr names a column with the share of the OCR confidence; without one, or where it is null, it counts as 1.
    """
    k, v = F.col(kind), F.col(record)
    parts = {"completeness": schema_completeness(k, v), "data_quality": data_quality(v), "field_confidence": F.lit(FIELD_CONFIDENCE), "consistency": consistency(k, v), "ocr_quality": F.coalesce(F.col(ocr), F.lit(1.0)) if ocr else F.lit(1.0)}
    whole = reduce(lambda a, b: a + b, [F.col(f"_{p}") * w for p, w in WEIGHTS.items()])
    out = records.withColumns({f"_{p}": c for p, c in parts.items()}).withColumn("_whole", whole)
    shown = {p: F.round(F.col(f"_{p}"), 3) for p in parts}
    return out.withColumns({**shown, "overall": F.round("_whole", 3), "grade": confidence_grade(F.col("_whole"))}).drop("_whole", *[f"_{p}" for p in parts])


def explain_score(completeness: Column, quality: Column, consistent: Column, ocr: Column) -> Column:
    """What the parts of a score say."""
    missing = F.concat(F.lit("⚠️ "), F.bround((1 - completeness) * 100, 0).cast("int").cast("string"), F.lit("% of required fields are missing"))
    return F.array_compact(
        F.array(
            F.when(completeness < 1.0, missing).otherwise("✅ All required fields are present"),
            F.when(quality < 0.8, "⚠️ Some fields have missing or invalid data").otherwise("✅ Data quality is good"),
            F.when(consistent < 1.0, "⚠️ Some inconsistencies detected in data"),
            F.when(ocr < 0.9, "⚠️ OCR confidence is below optimal (scanned document)"),
        )
    )


def recommend_score(completeness: Column, quality: Column, consistent: Column, ocr: Column) -> Column:
    """What to do about the parts of a score."""
    said = F.array_compact(
        F.array(
            F.when(completeness < 0.9, "Review document to fill in missing required fields"),
            F.when(quality < 0.8, "Manually verify and correct invalid or missing field values"),
            F.when(consistent < 0.9, "Check for logical errors (e.g., totals, dates)"),
            F.when(ocr < 0.8, "Consider rescanning document at higher DPI (300+ recommended)"),
        )
    )
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("✅ Extraction quality is excellent!")))


def required_field_expand(records: DataFrame, id_col: str = "doc_id", kind: str = "document_type", record: str = "record") -> DataFrame:
    """(id, field, present) for every required field of every record of a registered type."""
    v = F.col(record)
    rows = by_type(F.col(kind), lambda t: F.array(*[F.struct(F.lit(p).alias("field"), has_content(v, p).alias("present")) for p in REQUIRED[t]]), F.array().cast("array<struct<field: string, present: boolean>>"))
    return records.select(id_col, F.inline(rows))


def walk_leaves(record: Column) -> Column:
    """Array of (path, value) of every leaf that is there, at any depth and for any type; lists are one leaf, as JSON."""
    return F.transform(walk(record), lambda e: F.struct(e["path"].alias("path"), text_of(e["value"]).alias("value")))
