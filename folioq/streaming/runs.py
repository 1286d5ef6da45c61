"""Streams that are started, stopped and taken up again: what has arrived is worked off, written, and not written twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioq.functions.json import strict
from folioq.functions.variants import shape
from folioq.operators.audit import audit

#: Where a line that is no record goes.
MALFORMED, AUDITED = "malformed", "audited"


def arrivals(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """(value, path, arrived): lines of text below a path as a stream, at most `files` new files a step; later steps take the rest."""
    return spark.readStream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"))


def records_of(lines: DataFrame) -> DataFrame:
    """lines with document_type, record and outcome: a line that is no JSON object, an empty one included, is malformed and keeps its text only."""
    v = strict(F.col("value"))
    good = F.coalesce(shape(v) == "OBJECT", F.lit(False))
    kind = F.coalesce(F.try_variant_get(v, "$.classification.document_type", "string"), F.try_variant_get(v, "$.document_type", "string"), F.lit("other"))
    return lines.withColumns({"document_type": F.when(good, kind), "record": F.when(good, v), "outcome": F.when(good, AUDITED).otherwise(MALFORMED)})


def audit_lines(lines: DataFrame, as_of: Column) -> DataFrame:
    """Audits of records of any type, one a line; malformed lines pass through with outcome malformed, is_valid false and score 0.

    lines has value, and may have path and arrived. Works on streams and batches alike; nothing is shuffled and no state is kept.
    """
    report = audit(records_of(lines), as_of)
    good = F.col("outcome") == AUDITED
    return report.withColumns({"is_valid": good & F.col("is_valid"), "score": F.when(good, F.col("score")).otherwise(0.0), "grade": F.when(good, F.col("grade"))}).withColumn("record", F.to_json("record")).withColumn("value", F.when(~good, F.col("value")))


def dedup(uploads: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first upload to come of each key, a stream with a watermark of `delay`: a repeat within the delay is dropped, and so is what comes later than the
    watermark; after it a key is forgotten and counts as new. State is one row a key of the last `delay`, dealt by the key's hash. Rows without a time go, as
    no watermark can place them; rows without a key are repeats of each other."""
    timed = uploads.filter(F.col(f"`{ts}`").isNotNull()).withColumn(ts, F.col(f"`{ts}`").cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def work_off(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Write all that has arrived as Parquet, and return the query once it has ended. Taken up again with the same checkpoint, it goes on after the last step that was
    finished; a step that was cut off is done again, and the sink's log keeps its rows single."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    query = (writer.partitionBy(by) if by else writer).start()
    query.awaitTermination()
    return query
