"""Records as section, key and value rows, from the registry; one form for all types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.registry import SCHEMAS

ROW = "array<struct<section: string, row_no: bigint, key: string, value: string>>"


def label(key: str) -> str:
    return key.replace("_", " ").title()


def rows_of(section: str, fields: dict[str, Any], value: Column, row_no: Column, prefix: str = "", joined: str = "; ") -> list[Column]:
    """Structs for the fields of an object; nested objects prefix their keys, lists are joined."""
    out: list[Column] = []
    for k, spec in fields.items():
        x = value[k]
        if isinstance(spec, dict):
            out += rows_of(section, spec, x, row_no, f"{prefix}{label(k)} > ", joined)
        else:
            text = F.array_join(F.transform(x, lambda v: v.cast("string")), joined) if isinstance(spec, list) else F.to_json(x) if spec.startswith("map") else x.cast("string")
            out.append(F.struct(F.lit(section).alias("section"), row_no.cast("long").alias("row_no"), F.lit(prefix + label(k)).alias("key"), F.coalesce(text, F.lit("")).alias("value")))
    return out


def export_rows(kind: str, record: Column, joined: str = "; ") -> Column:
    """All rows of a record of a type: its own fields, then a section per object and per list, one row number per item."""
    flat = {k: v for k, v in SCHEMAS[kind].items() if not isinstance(v, (dict, list))}
    parts = [F.array(*rows_of(label(kind), flat, record, F.lit(0), "", joined)).cast(ROW)]
    for k, spec in SCHEMAS[kind].items():
        if isinstance(spec, dict):
            parts.append(F.array(*rows_of(label(k), spec, record[k], F.lit(0), "", joined)).cast(ROW))
        elif isinstance(spec, list):
            parts.append(F.coalesce(list_rows(k, spec[0], record[k], joined), F.array().cast(ROW)))
    return F.concat(*parts)


def list_rows(key: str, spec: Any, items: Column, joined: str) -> Column:
    def of(x: Column, i: Column) -> Column:
        if isinstance(spec, dict):
            return F.array(*rows_of(label(key), spec, x, i + 1, "", joined)).cast(ROW)
        return F.array(F.struct(F.lit(label(key)).alias("section"), (i + 1).cast("long").alias("row_no"), F.lit(label(key)).alias("key"), F.coalesce(x.cast("string"), F.lit("")).alias("value"))).cast(ROW)

    return F.flatten(F.transform(items, of))


def export_records(records: DataFrame, kind: str, id_col: str = "doc_id", record: str = "record") -> DataFrame:
    """(id, section, row_no, key, value) of typed records; null values are empty texts. A null record has no rows."""
    return records.filter(F.col(record).isNotNull()).select(id_col, F.inline(export_rows(kind, F.col(record))))


def export_generic(docs: DataFrame, id_col: str, scalars: list[str], fields: Column | None, text_col: str) -> DataFrame:
    """Metadata rows, then the given (key, value) fields, or the first 1000 characters of the text where there are none."""
    meta = [F.struct(F.lit("Metadata").alias("section"), F.lit(0).cast("long").alias("row_no"), F.lit(label(c)).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in scalars]
    text = F.array(F.struct(F.lit("Text").alias("section"), F.lit(0).cast("long").alias("row_no"), F.lit("Content").alias("key"), F.substring(F.coalesce(text_col, F.lit("")), 1, 1000).alias("value")))
    rest = text if fields is None else F.when(F.size(fields) > 0, F.transform(fields, lambda f: F.struct(F.lit("Fields").alias("section"), F.lit(0).cast("long").alias("row_no"), f["key"].alias("key"), f["value"].alias("value")))).otherwise(text)
    return docs.select(id_col, F.inline(F.concat(F.array(*meta), rest)))
