"""Queries over the catalogue: documents as envelopes, orders and customers as records and owners, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import catalogue as C
from folioq.operators import envelopes as E
from folioq.plans.base import query, read, scratch
from folioq.registry import SCHEMAS
from folioq.sources import catalogue as K

#: What the pages and lookups ask for.
OWNER, ASKED, PAGE, SIZE = 7, 11, 2, 20


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a batch of envelopes: fifty owners, every fourth failed, a JSON output each and a CSV for every second."""
    k = F.col("doc_id")
    uri = lambda f: F.concat(F.lit("out/"), k.cast("string"), F.lit("." + f))
    exports = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("json").alias("f"), uri("json").alias("u")), F.when(k % 2 == 0, F.struct(F.lit("csv").alias("f"), uri("csv").alias("u"))))))
    return read(spark, sf_dir, "documents").select(
        k.alias("extraction_id"), (k % 50).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + k * 17 % 5000).alias("created_at"), F.coalesce("source", F.lit("unknown")).alias("filename"), F.col("text").alias("content"),
        F.when(k % 4 == 0, "error").otherwise("success").alias("status"), F.coalesce("lang", F.lit("other")).alias("document_type"), F.to_json(F.struct("lang")).alias("record"), exports.alias("exports"),
    )


#: Rows of each table once the batches are kept, by a condition on the documents.
def kept_sql(where: str) -> str:
    of = lambda name, more="true", n="count(*)": f"SELECT '{name}' entity, {n} n FROM documents WHERE {more}"
    both = "count(*) + count(*) FILTER (doc_id % 2 = 0)"
    twice = "count(DISTINCT (doc_id % 50, doc_id % 3))"
    return " UNION ALL ".join([of("users", n=twice), of("documents"), of("extractions", where), of("extraction_results", f"doc_id % 4 <> 0 AND {where}"), of("extraction_outputs", where, both), of("validation_reports", f"doc_id % 4 <> 0 AND {where}"), of("audit_logs")])


def kept(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """Documents kept in three batches, of which one is written twice, as after a failure: the folder and the names of the tables."""
    path, names = scratch(spark), []
    for turn in (0, 1, 2, 1):
        part = batch(spark, sf_dir).filter(F.col("extraction_id") % 3 == turn)
        score = (F.col("extraction_id") % 100).cast("int")
        reports = part.filter("status = 'success'").select("extraction_id", F.when(score < 50, "failed").otherwise("passed").alias("status"), F.lit("[]").alias("issues"), score.alias("quality_score"), F.lit("{}").alias("metadata"))
        tables = C.catalogue_tables(part, reports=reports)
        K.sink_catalogue(tables, path, f"b{turn}")
        names = list(tables)
    return path, names


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, t in tables.items()])


@query(kept_sql("true"))
def sink_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table after three batches, one of them written again."""
    path, names = kept(spark, sf_dir)
    return sizes(K.read_catalogue(spark, path, names))


@query("SELECT sha256('document:' || doc_id) id, sha256(coalesce(text, '')) checksum, doc_id % 50 user_id, coalesce(source, 'unknown') filename, CAST(strlen(text) AS BIGINT) size_bytes, 'b' || doc_id % 3 AS batch FROM documents")
def scan_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as it is kept."""
    path, _ = kept(spark, sf_dir)
    return K.read_catalogue(spark, path, ["documents"])["documents"].select("id", "checksum", "user_id", "filename", "size_bytes", "batch")


@query("SELECT CAST(doc_id AS VARCHAR) extraction_id, f AS format, 'out/' || doc_id || '.' || f storage_uri FROM documents, (VALUES ('json'), ('csv')) t(f) WHERE f = 'json' OR doc_id % 2 = 0")
def output_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalogue_tables(batch(spark, sf_dir))["extraction_outputs"].select("extraction_id", "format", "storage_uri")


@query("SELECT CAST(doc_id AS VARCHAR) extraction_id, 'out/' || doc_id || '.csv' storage_uri FROM documents WHERE doc_id % 2 = 0")
def output_for_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV of every extraction that has one."""
    tables = C.catalogue_tables(batch(spark, sf_dir))
    return C.output_for_download(tables["extraction_outputs"], tables["extractions"], "csv")


@query("SELECT CAST(doc_id AS VARCHAR) extraction_id, 'out/' || doc_id || '.json' storage_uri FROM documents")
def json_output_for_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = C.catalogue_tables(batch(spark, sf_dir))
    return C.output_for_download(tables["extraction_outputs"], tables["extractions"], "json")


@query(f"SELECT doc_id extraction_id, coalesce(lang, 'other') document_type FROM documents WHERE doc_id % 50 = {OWNER}")
def owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.owned(batch(spark, sf_dir), OWNER).select("extraction_id", "document_type")


@query(f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey = {ASKED}")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one owner has."""
    return C.owned(read(spark, sf_dir, "orders"), ASKED, "o_custkey").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(kept_sql("NOT (doc_id % 10 = 3 AND doc_id % 3 < 2)"))
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in the kept tables once every tenth extraction of two batches is removed with its results, outputs and reports; documents and the audit log keep theirs."""
    path, names = kept(spark, sf_dir)
    gone = read(spark, sf_dir, "documents").filter("doc_id % 10 = 3 AND doc_id % 3 < 2").select(F.col("doc_id").cast("string").alias("id"))
    K.delete_stored(spark, path, names, gone)
    return sizes(K.read_catalogue(spark, path, names))


@query("SELECT user_id, count(*) n_files, count(*) BETWEEN 1 AND 20 accepted FROM events GROUP BY 1")
def batch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch_limit(read(spark, sf_dir, "events"), "user_id")


ENVELOPE = "(SELECT doc_id, doc_id % 4 e, lang, doc_id % 100 / 100.0 c, CASE WHEN doc_id % 3 > 0 THEN 'English' END l, CAST(doc_id % 60 AS DOUBLE) s FROM documents)"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON envelopes; failed ones have an error and a short metadata block."""
    k = F.col("doc_id")
    meta = F.struct(F.when(k % 3 > 0, "English").alias("detected_language"), (k % 60).cast("double").alias("processing_time_seconds"))
    good = F.to_json(F.struct(F.lit("success").alias("status"), meta.alias("metadata"), F.struct(F.col("lang").alias("document_type")).alias("classification"), F.struct(k.alias("n")).alias("structured_data"), F.struct((k % 100 / 100).alias("overall_confidence")).alias("comprehensive_confidence")))
    bad = F.to_json(F.struct(F.lit("error").alias("status"), F.lit("unreadable").alias("error"), meta.alias("metadata")))
    return read(spark, sf_dir, "documents").select(k, F.parse_json(F.when(k % 4 == 0, bad).otherwise(good)).alias("record"))


@query(f"SELECT doc_id, CASE WHEN e = 0 THEN 'other' ELSE coalesce(lang, 'other') END document_type, CASE WHEN e > 0 THEN '{{\"n\":' || doc_id || '}}' END structured_data, CASE WHEN e > 0 THEN CAST(c AS DOUBLE) END confidence, coalesce(l, 'Unknown') detected_language FROM {ENVELOPE}")
def results_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callers get of a result; failed extractions have no data."""
    return envelopes(spark, sf_dir).select("doc_id", E.results_projection(F.col("record")).alias("p")).select("doc_id", "p.*")


@query(f"SELECT doc_id, CASE WHEN e = 0 THEN 'error' ELSE 'success' END status, CASE WHEN e > 0 THEN lang END document_type, CASE WHEN e > 0 THEN CAST(c AS DOUBLE) END overall_confidence, l AS language, s AS seconds FROM {ENVELOPE}")
def response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir).select("doc_id", E.response_projection(F.col("record")).alias("p")).select("doc_id", "p.*")


@query("""WITH r AS (SELECT event_id, 'audit_' || event_id report, count(value) n FROM events GROUP BY ALL) SELECT doc_id, 'audit_' || doc_id * 7 asked, coalesce(n > 0, false) has_value, report IS NOT NULL found FROM documents LEFT JOIN r ON report = 'audit_' || doc_id * 7""")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that every document asks for by name, and whether there is one."""
    asked = F.concat(F.lit("audit_"), (F.col("doc_id") * 7).cast("string"))
    reports = read(spark, sf_dir, "events").groupBy("event_id").agg(F.count("value").alias("n")).select(F.concat(F.lit("audit_"), F.col("event_id").cast("string")).alias("report"), "n")
    joined = read(spark, sf_dir, "documents").select("doc_id", asked.alias("asked")).join(reports, F.col("asked") == F.col("report"), "left")
    return joined.select("doc_id", "asked", F.coalesce(F.col("n") > 0, F.lit(False)).alias("has_value"), F.col("report").isNotNull().alias("found"))


@query(f"SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT {SIZE} OFFSET {(PAGE - 1) * SIZE}")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of reports, newest first."""
    return C.page(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", PAGE, SIZE)


@query(f"SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT {SIZE} OFFSET {(PAGE - 1) * SIZE}")
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of records, newest first."""
    return C.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", PAGE, SIZE)


@query("SELECT user_id, arg_max(event_id, epoch_us(ts)::HUGEINT * 1000000000 - event_id) latest FROM events WHERE event_type <> 'view' GROUP BY 1")
def latest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent event of each user that is no mere view, by a partially aggregated arg-max."""
    kept = read(spark, sf_dir, "events").filter("event_type <> 'view'")
    return kept.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("latest"))


@query("SELECT row_number() OVER (ORDER BY event_type) - 1 AS place, event_type stage, count(*) n FROM events GROUP BY event_type")
def stage_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages in the order of their names; there are as many rows as stages."""
    counted = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    listed = counted.agg(F.array_sort(F.collect_list(F.struct("stage", "n"))).alias("s"))
    return listed.select(F.posexplode("s").alias("place", "x")).select(F.col("place").cast("long").alias("place"), "x.stage", "x.n")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'cheque' END document_type FROM events WHERE event_id % 3 < 2")
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of types in mixed case; those of a type without a schema go."""
    kinds = F.array(F.lit("Invoice"), F.lit("CHEQUE"), F.lit("form"))
    typed = read(spark, sf_dir, "events").select("event_id", F.lower(F.get(kinds, (F.col("event_id") % 3).cast("int"))).alias("document_type"))
    return typed.filter(F.col("document_type").isin(*SCHEMAS))


@query("SELECT event_type document_type, round(avg(value), 4) mean_ocr, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) structured_share, round(avg(CASE WHEN event_type <> 'view' THEN 1.0 ELSE 0.0 END), 4) typed_share FROM events GROUP BY ROLLUP (1)")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence, share with data and share of known types, by type and overall."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return read(spark, sf_dir, "events").rollup(F.col("event_type").alias("document_type")).agg(F.round(F.avg("value"), 4).alias("mean_ocr"), share(F.col("value").isNotNull()).alias("structured_share"), share(F.col("event_type") != "view").alias("typed_share"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) n_files, coalesce(quality = 1, false) type_match FROM documents LEFT JOIN labels USING (doc_id)")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with whether its expected type is met; no label is no match."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    sizes = docs.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_files"))
    return docs.join(labels, "doc_id", "left").join(sizes, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "n_files", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("type_match"))


@query("SELECT doc_id, false is_valid, CAST(0 AS DOUBLE) score, 'Extraction not found' message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_input_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed report for every document without a result."""
    gone = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return gone.select("doc_id", F.lit(False).alias("is_valid"), F.lit(0.0).alias("score"), F.lit("Extraction not found").alias("message"))


@query("SELECT count(*) n_files, count(*) FILTER (length(text) > 0) n_success, count(*) FILTER (text IS NULL OR length(text) = 0) n_failed, round(avg(CAST(n_chars AS DOUBLE)) , 4) mean_chars, round(avg(quality), 4) accuracy FROM documents LEFT JOIN labels USING (doc_id)")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, successes, failures, mean size, and accuracy over labelled files only."""
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.length("text") > 0, F.lit(False))
    return joined.agg(F.count("*").alias("n_files"), F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_failed"), F.round(F.avg(F.col("n_chars").cast("double")), 4).alias("mean_chars"), F.round(F.avg("quality"), 4).alias("accuracy"))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) window_start, event_type kind, count(*) n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) failed_share, round(avg(value), 4) mean_value FROM events GROUP BY 1, 2")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute rates; the same function serves a stream."""
    from folioq.streaming.rates import stream_rates

    return stream_rates(read(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) k FROM g)
SELECT user_id, min(ts) session_start, max(ts) + INTERVAL '30 minutes' session_end, count(*) n FROM n GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with a gap of thirty minutes."""
    from folioq.streaming.rates import stream_sessions as sessions

    return sessions(read(spark, sf_dir, "events"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) k FROM events) WHERE k = 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct uploads; a batch keeps the least id of each, where a stream keeps the first to come."""
    from folioq.streaming.rates import first_uploads

    events = read(spark, sf_dir, "events").withColumn("checksum", F.sha2(F.to_json(F.struct("user_id", "event_type", "props")), 256))
    return first_uploads(events, "checksum", "event_id").select("event_id")
