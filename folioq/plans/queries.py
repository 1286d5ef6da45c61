"""Registered queries: the record operators over the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.plans import audit_types, audits, catalogues, derived, fleet, inputs, jsons, records, streams, tables, texts  # noqa: F401 (registers its queries)
from folioq.plans.base import ORACLE_SQL, QUERIES, query, read

WORDS = r"list_filter(regexp_split_to_array(coalesce(text,''), '[\s\x{0B}\x{85}\p{Z}]+'), lambda x: x <> '')"

@query(f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) n_words, CAST(length(coalesce(text,'')) AS BIGINT) n_text FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_text"))


@query(rf"""WITH c AS (SELECT doc_id, coalesce(text,'') t, {WORDS} w FROM documents), d AS (SELECT doc_id, t, len(w) n, len(list_filter(w, lambda x: regexp_matches(x,'[a-zA-Z\x{{0900}}-\x{{097F}}\x{{0A80}}-\x{{0AFF}}]{{3,}}'))) r,
 length(regexp_replace(t,'[^\p{{L}}\p{{N}}]','','g')) a, length(regexp_replace(t,'[\n ]','','g')) s FROM c)
SELECT doc_id, CASE WHEN length(regexp_replace(t,'^\s+|\s+$','','g'))<20 OR n=0 THEN true ELSE r/n<0.40 OR (CASE WHEN s>0 THEN 1-a/s ELSE 1.0 END)>0.35 END garbage FROM d""")
def garbage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.garbage_text(F.col("text")).alias("garbage"))


@query("""WITH d AS (SELECT doc_id, coalesce(text,'') t FROM documents), k AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t)>8000 THEN CAST(ceil((length(t)-4000)/3500.0) AS BIGINT)+1 ELSE 1 END)) chunk FROM d)
SELECT doc_id, chunk, sha256(CASE WHEN length(t)>8000 THEN substr(t, chunk*3500+1, 4000) ELSE t END) chunk_sha256 FROM k""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    chunks = docs.select("doc_id", F.posexplode(T.chunk_text(F.col("t"))).alias("chunk", "piece"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2(F.col("piece").cast("binary"), 256).alias("chunk_sha256"))


@query("SELECT doc_id, sha256(coalesce(text,'')) checksum FROM documents")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("checksum"))


@query("SELECT d.doc_id, coalesce(source,'unknown') filename, CAST(quality AS DOUBLE) confidence FROM documents d LEFT JOIN labels l USING (doc_id)")
def extraction_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their result, if there is one."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("filename"), F.col("quality").cast("double").alias("confidence"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) k FROM orders) WHERE k=1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each owner, by a partially aggregated arg-max rather than a window."""
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest)


@query("SELECT event_id, user_id, epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) delta_us FROM events")
def stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microseconds since the event before of the same user."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta_us"))


@query("SELECT event_type stage, count(*) n, round(avg(value),4) mean_value FROM events GROUP BY 1")
def stage_timing_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("SELECT count(*) total FROM orders")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before paging."""
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("total"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one type."""
    return read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source")


@query("SELECT user_id, count(*) total, count(value) processed, count(*)-count(value) failed, CASE WHEN count(value)=count(*) THEN 'success' ELSE 'partial' END status FROM events GROUP BY 1")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with and without a value by batch; a batch with a failed item is partial."""
    counted = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count("value").alias("processed"))
    failed = F.col("total") - F.col("processed")
    return counted.select("user_id", "total", "processed", failed.alias("failed"), F.when(failed == 0, "success").otherwise("partial").alias("status"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]' ELSE text END shown FROM documents")
def truncate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 characters of longer texts."""
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate_json(F.col("text"), 200).alias("shown"))
