"""Rates, sessions, deduplication and audits over a stream of records; all of it works on batch DataFrames too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators.validation import validate_invoices

#: Type of an arriving invoice record.
INVOICE = "doc_id string, subtotal double, tax double, total double, line_items array<struct<quantity: double, unit_price: double, total: double>>"


def watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def stream_rates(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", window: str = "5 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Per kind and window, tumbling or sliding: rows, share of failures (rows without a value) and mean value."""
    late = watermarked(events, ts, delay)
    grouped = late.groupBy(F.window(ts, window, slide).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).isNull().cast("double")), 4).alias("failed_share"), F.round(F.avg(value), 4).alias("mean_value"))
    return grouped.select(F.col("w.start").alias("window_start"), "kind", "n", "failed_share", "mean_value")


def stream_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per user and session: its start, its end (the last event and the gap) and its events."""
    late = watermarked(events, ts, delay)
    grouped = late.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_dedup(uploads: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first upload of each checksum within the delay; a batch drops repeats outright."""
    return watermarked(uploads, ts, delay).dropDuplicatesWithinWatermark([key]) if uploads.isStreaming else uploads.dropDuplicates([key])


def first_uploads(uploads: DataFrame, key: str, order: str) -> DataFrame:
    """The batch form with a fixed choice: the upload with the least order value of each key."""
    return uploads.groupBy(key).agg(F.min(order).alias(order))


def stream_validate(spark: SparkSession, path: str, schema: str = INVOICE) -> DataFrame:
    """Audit reports of the JSON records that arrive below a path, one object a line."""
    return validate_invoices(spark.readStream.schema(schema).json(path))
