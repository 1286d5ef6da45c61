"""Tolerant readers of JSON replies; results are VARIANT or typed arrays, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioq.operators.validation import FINDING, TEST

ISSUE = "array<struct<severity: string, field: string, message: string, expected_value: string, actual_value: string>>"
TESTS = "array<struct<test_name: string, assertion: string, passed: boolean, detail: string, expected_value: string, actual_value: string>>"


def strict(text: Column) -> Column:
    """The text as one JSON value with nothing after it, which the parser alone would pass over; null otherwise."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_json_object(text: Column) -> Column:
    """The text as JSON, else its fenced object, else what lies between its outer braces; null if none can be read."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(strict(text), *[strict(F.nullif(x, F.lit(""))) for x in (fenced, braced)])


def balanced(text: Column) -> Column:
    """The first [...] whose brackets balance; null without one. One pass over the characters."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        done = s["last"] > 0
        depth = F.when(done, s["depth"]).when(c == "[", s["depth"] + 1).when(c == "]", s["depth"] - 1).otherwise(s["depth"])
        at = s["at"] + 1
        first = F.when(~done & (c == "[") & (s["depth"] == 0), at).otherwise(s["first"])
        last = F.when(~done & (c == "]") & (depth == 0) & (s["first"] > 0), at).otherwise(s["last"])
        return F.struct(depth.alias("depth"), at.alias("at"), first.alias("first"), last.alias("last"))

    found = F.aggregate(F.split(text, ""), start, step)
    return F.element_at(F.transform(F.array(found), lambda s: F.when(s["last"] > 0, F.substring(text, s["first"], s["last"] - s["first"] + 1))), 1)


def parse_json_array(text: Column) -> Column:
    """Array of variants: a list, an object as a list of one, else the first balanced or the widest [...]; empty if none can be read."""
    bare = F.btrim(text)
    clean = F.when(bare.startswith("```"), F.btrim(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*\n?", ""), r"\n?\s*```\s*$", ""))).otherwise(bare)
    widest = F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))
    direct = strict(clean)
    single = F.when(clean.startswith("{") & direct.isNotNull(), F.array(direct))
    listed = [F.try_variant_get(v, "$", "array<variant>") for v in (direct, strict(balanced(clean)), strict(widest))]
    return F.coalesce(listed[0], single, listed[1], listed[2], F.array().cast("array<variant>"))


def classification_ingest(text: Column) -> Column:
    """(document_type, confidence, reasoning, alternative_type) of a reply; `other` with confidence 0 without a type."""
    v = parse_json_object(text)
    get = lambda key, kind="string": F.try_variant_get(v, f"$.{key}", kind)
    read = F.struct(get("document_type").alias("document_type"), F.coalesce(get("confidence", "double"), F.lit(0.0)).alias("confidence"), get("reasoning").alias("reasoning"), get("alternative_type").alias("alternative_type"))
    failed = F.struct(F.lit("other").alias("document_type"), F.lit(0.0).alias("confidence"), F.lit("Classification failed: Invalid classification response format").alias("reasoning"), F.lit(None).cast("string").alias("alternative_type"))
    return F.when(get("document_type").isNotNull(), read).otherwise(failed)


def objects(text: Column) -> Column:
    """The objects of a reply's array; anything else is skipped."""
    return F.filter(parse_json_array(text), lambda v: F.to_json(v).startswith("{"))


def issue_ingest(text: Column) -> Column:
    """Findings from a reply: unknown severities are warnings, a missing message gets a default."""

    def one(v: Column) -> Column:
        get = lambda key: F.try_variant_get(v, f"$.{key}", "string")
        severity = F.lower(F.coalesce(get("severity"), F.lit("warning")))
        return F.struct(
            F.lit("contextual_sanity").alias("pillar"),
            F.when(severity.isin("error", "warning", "info"), severity).otherwise("warning").alias("severity"),
            get("field").alias("field"),
            F.coalesce(get("message"), F.lit("Contextual sanity issue")).alias("message"),
            get("expected_value").alias("expected"),
            get("actual_value").alias("actual"),
        )

    return F.transform(objects(text), one).cast(f"array<{FINDING}>")


def truth_ingest(text: Column) -> Column:
    """Truth tests from a reply, with defaults for what is missing."""

    def one(v: Column) -> Column:
        get = lambda key, kind="string": F.try_variant_get(v, f"$.{key}", kind)
        return F.struct(
            F.coalesce(get("test_name"), F.lit("unnamed_test")).alias("test_name"),
            F.coalesce(get("assertion"), F.lit("")).alias("assertion"),
            F.coalesce(get("passed", "boolean"), F.lit(False)).alias("passed"),
            get("detail").alias("detail"),
            get("expected_value").alias("expected_value"),
            get("actual_value").alias("actual_value"),
        )

    return F.transform(objects(text), one).cast(f"array<{TEST}>")
