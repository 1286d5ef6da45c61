"""The catalogue: tables derived from a batch of envelopes, lookups, pages, and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validation_rows(report: DataFrame, id_col: str) -> DataFrame:
    """(extraction_id, status, issues, quality_score, metadata) of audit reports."""
    counts = F.to_json(F.struct(F.col("n_errors").alias("errors"), F.col("n_warnings").alias("warnings")))
    score = F.floor(F.col("score").cast("decimal(9,4)") * 100).cast("int")
    return report.select(F.col(id_col).alias("extraction_id"), F.when(F.col("is_valid"), "passed").otherwise("failed").alias("status"), F.to_json("findings").alias("issues"), score.alias("quality_score"), counts.alias("metadata"))


def catalogue_tables(envelopes: DataFrame, user: str = "user_id", ts: str = "created_at", reports: DataFrame | None = None) -> dict[str, DataFrame]:
    """users, documents, extractions, extraction_results, extraction_outputs, validation_reports and audit_logs of (extraction_id, user, ts, filename,
    content, status, document_type, record, exports), exports being a map from format to uri, and of reports as validation_rows gives them.

    Each is a projection of the one batch; users are its distinct ones. A document's id follows from its extraction's, so that equal contents stay two documents;
    the checksum tells that they are equal.
    """
    e, key = envelopes, F.col("extraction_id").cast("string")
    doc = F.sha2(F.concat(F.lit("document:"), key).cast("binary"), 256)
    checksum = F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256)
    none = e.select(key.alias("extraction_id"), "status", F.lit("[]").alias("issues"), F.lit(0).alias("quality_score"), F.lit("{}").alias("metadata")).limit(0)
    return {
        "users": e.filter(F.col(user).isNotNull()).groupBy(F.col(user).alias("id")).agg(F.min(ts).alias("created_at")),
        "documents": e.select(doc.alias("id"), F.col(user).alias("user_id"), "filename", F.octet_length("content").cast("long").alias("size_bytes"), checksum.alias("checksum"), F.col(ts).alias("created_at")),
        "extractions": e.select(key.alias("id"), doc.alias("document_id"), F.col(user).alias("user_id"), "status", F.lit(1).alias("version"), F.col(ts).alias("created_at")),
        "extraction_results": e.filter(F.col("status") == "success").select(key.alias("extraction_id"), "document_type", F.col("record").alias("structured_data"), F.col(ts).alias("created_at")),
        "extraction_outputs": outputs(e, key, ts),
        "validation_reports": none if reports is None else reports.withColumn("extraction_id", F.col("extraction_id").cast("string")),
        "audit_logs": e.select(F.col(user).alias("user_id"), F.lit("extract").alias("action"), F.lit("extraction").alias("resource_type"), key.alias("resource_id"), F.col(ts).alias("created_at")),
    }


def outputs(envelopes: DataFrame, key: Column, ts: str) -> DataFrame:
    """One row per extraction and format."""
    return envelopes.select(key.alias("extraction_id"), F.explode("exports").alias("format", "storage_uri"), F.col(ts).alias("created_at"))


def page(df: DataFrame, newest: str, tie: str, number: int = 1, size: int = 20) -> DataFrame:
    """Page `number` of `size` rows, newest first; both are brought within 1 and 100."""
    size, number = min(100, max(1, size)), max(1, number)
    return df.orderBy(F.desc(newest), tie).offset((number - 1) * size).limit(size)


def owned(df: DataFrame, user: Column | int | str, user_col: str = "user_id") -> DataFrame:
    """Rows of one owner."""
    return df.filter(F.col(user_col) == user)


def output_for_download(outputs_: DataFrame, extractions: DataFrame, fmt: str, user: object | None = None) -> DataFrame:
    """(extraction_id, storage_uri): the least output of the format for every extraction, of one owner if given."""
    own = extractions if user is None else owned(extractions, user)
    found = outputs_.filter(F.col("format") == fmt).join(own.select(F.col("id").alias("extraction_id")), "extraction_id")
    return found.groupBy("extraction_id").agg(F.min("storage_uri").alias("storage_uri"))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the extractions of ids (column id) and all that belongs to them."""
    gone = ids.select(F.col("id").alias("_gone"))
    key = lambda name: "id" if name == "extractions" else "resource_id" if name == "audit_logs" else "extraction_id"
    return {name: df if name == "audit_logs" or key(name) not in df.columns else df.join(gone, df[key(name)] == gone["_gone"], "left_anti") for name, df in tables.items()}


def batch_limit(items: DataFrame, batch: str, most: int = 20) -> DataFrame:
    """(batch, n_files, accepted): batches have one to `most` files."""
    counted = items.groupBy(batch).agg(F.count("*").alias("n_files"))
    return counted.withColumn("accepted", F.col("n_files").between(1, most))
