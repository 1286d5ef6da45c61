"""Queries that run streams over what has arrived, in several steps with a stop in between, with SQL for the rows that must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.plans.audit_types import AS_OF, COUNTED, mixed
from folioq.plans.base import query, read, scratch
from folioq.streaming import runs


def arrived(spark: SparkSession, path: str, lines: DataFrame, key: str) -> None:
    """Lines written below a path by thirds of their key, with files of four tasks each."""
    lines.withColumn("third", F.col(key) % 3).repartition(4).drop(key).write.mode("append").partitionBy("third").text(path)


@query(f"""WITH c AS ({COUNTED}), s AS (SELECT *, round(least(1.0, CAST(0.55 AS DOUBLE) * greatest(0.0, 1 / (1 + CAST(0.4 AS DOUBLE) * (n_errors - CAST(k % 4 = 1 AS INT))) - CAST(0.04 AS DOUBLE) * (n_warnings - CAST(k % 4 = 2 AS INT))) + CAST(0.45 AS DOUBLE) * pass_rate), 4) score FROM c)
SELECT k doc_id, 'audited' outcome, n_errors - CAST(k % 4 = 1 AS INT) = 0 is_valid, score, n_tests::BIGINT n_tests FROM s UNION ALL SELECT c_custkey, 'malformed', false, 0.0, 0 FROM customer WHERE c_custkey % 7 = 0""")
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of nine kinds as lines of JSON, audited as a stream; every seventh comes once more, cut off in the middle. The stream is stopped after two thirds
    have arrived and taken up again for the rest."""
    whole = mixed(spark, sf_dir).select("doc_id", F.concat(F.lit('{"document_type": "'), "document_type", F.lit('", "doc_id": '), "doc_id", F.lit(", "), F.substr(F.to_json("record"), F.lit(2))).alias("line"))
    cut = whole.filter("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("#"), "doc_id", F.lit("# "), F.left("line", F.length("line") - 1)).alias("line"))
    lines, path = whole.unionByName(cut), scratch(spark)
    for part in ("doc_id % 3 < 2", "doc_id % 3 = 2"):
        arrived(spark, f"{path}/in", lines.filter(part), "doc_id")
        runs.work_off(runs.audit_lines(runs.arrivals(spark, f"{path}/in"), F.to_date(F.lit(AS_OF))), f"{path}/out", f"{path}/state", by="outcome")
    told = F.coalesce(F.get_json_object("record", "$.doc_id"), F.regexp_extract("value", "^#([0-9]+)#", 1)).cast("long")
    return spark.read.parquet(f"{path}/out").select(told.alias("doc_id"), "outcome", "is_valid", "score", F.size("truth_tests").cast("long").alias("n_tests"))


@query("SELECT DISTINCT sha256(coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '')) checksum FROM events WHERE ts IS NOT NULL")
def stream_dedup_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of uploads whose first has come, from a stream that is stopped and taken up again, with a delay as long as the events' whole span."""
    checksum = F.sha2(F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("event_type", F.lit(""))).cast("binary"), 256)
    events, path = read(spark, sf_dir, "events").select("event_id", "ts", checksum.alias("checksum")), scratch(spark)
    span = events.agg(F.datediff(F.max("ts"), F.min("ts")).alias("days")).first().days or 0
    for turn in (0, 1):
        events.filter(F.col("event_id") % 2 == turn).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        runs.work_off(runs.dedup(stream, "checksum", "ts", f"{span + 1} days"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("checksum")
