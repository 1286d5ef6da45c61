"""Queries over inputs of several kinds and generic exports, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import exports as X
from folioq.operators import scoring as C
from folioq.operators import truth
from folioq.operators import validation as V
from folioq.plans.audits import AUDIT, invoices
from folioq.plans.base import query, read, scratch
from folioq.plans.records import PARTS, records
from folioq.sources import envelopes as S


@query("""SELECT event_id, CASE WHEN event_id % 8 IN (2, 3, 6, 7) THEN 'error' ELSE 'success' END status, CASE event_id % 8 WHEN 3 THEN 'Unsupported file type' WHEN 2 THEN 'Invalid JSON' WHEN 6 THEN 'Invalid JSON' WHEN 7 THEN 'Invalid CSV' END error,
CASE event_id % 8 WHEN 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN 1 THEN 'r' || event_id WHEN 4 THEN 'say "hi", ' || chr(10) || event_id WHEN 5 THEN 'late ' || event_id END first_value FROM events""")
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files: JSON, CSV, broken JSON, a suffix that isn't read, quoted cells with line breaks, a repeated header, junk after JSON, and an open quote."""
    k = F.col("event_id")
    said = k.cast("string")
    turn = (k % 8).cast("int")
    ext = F.get(F.array(*[F.lit(x) for x in (".json", ".CSV", ".json", ".xls", ".csv", ".csv", ".json", ".csv")]), turn)
    shapes = (F.col("props"), F.concat(F.lit("a,b\nr"), said, F.lit(",x\n")), F.lit("{broken"), F.lit("?"), F.concat(F.lit('b,"a"\r\n1,"say ""hi"", \n'), said, F.lit('"\r\n\r\n2')), F.concat(F.lit("a,a\nearly,late "), said), F.lit('{"k": 1} junk'), F.lit('a,b\n1,"open\n2'))
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("in/"), said, ext).alias("path"), F.coalesce(*[F.when(turn == i, x) for i, x in enumerate(shapes)]).alias("content"))
    first = F.coalesce(F.try_variant_get("record", "$.k", "string"), F.try_variant_get("record", "$.rows[0].a", "string"))
    return S.scan_dispatch(files).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("event_id"), "status", "error", first.alias("first_value"))


@query(r"SELECT doc_id, CASE WHEN b THEN 'error' ELSE 'success' END status, CASE WHEN b THEN 'No text' END error, CAST(coalesce(length(t), 0) AS BIGINT) length, CAST(len(list_filter(regexp_split_to_array(coalesce(t, ''), '[\s\x{0B}\x{85}\p{Z}]+'), lambda x: x <> '')) AS BIGINT) word_count FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END t, coalesce(doc_id % 10 = 0 OR trim(text) = '', true) b FROM documents)")
def batch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a batch; every tenth has nothing but a blank."""
    items = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("content"))
    return S.batch_extract(items).drop("content")


@query("""SELECT doc_id, 'Metadata' section, 'Lang' AS key, coalesce(lang, '') AS value FROM documents UNION ALL SELECT doc_id, 'Metadata', 'N Chars', coalesce(CAST(n_chars AS VARCHAR), '') FROM documents
UNION ALL SELECT doc_id, 'Fields', 'Source', coalesce(source, '') FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Text', 'Content', substr(coalesce(text, ''), 1, 1000) FROM documents WHERE doc_id % 3 <> 0""")
def export_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with flattened fields for every third document, and with the start of the text for the others."""
    fields = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("Source").alias("key"), F.coalesce("source", F.lit("")).alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("n_chars"), "text", "source")
    return X.export_generic(docs, "doc_id", ["lang", "n_chars"], fields, "text").drop("row_no")


@query(f"""SELECT k doc_id, 'Completeness' AS key, printf('%.1f%%', CAST(round(c, 3) AS DOUBLE) * 100) AS value FROM {PARTS} UNION ALL SELECT k, 'Data Quality', printf('%.1f%%', CAST(round(q, 3) AS DOUBLE) * 100) FROM {PARTS} UNION ALL SELECT k, 'Consistency', printf('%.1f%%', CAST(s AS DOUBLE) * 100) FROM {PARTS}""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score sheet of every record: its metrics as percentages."""
    scored = C.comprehensive_score(records(spark, sf_dir))
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    pairs = F.array(*[F.struct(F.lit(X.label(c)).alias("key"), percent(c).alias("value")) for c in ("completeness", "data_quality", "consistency")])
    return scored.select("doc_id", F.inline(pairs))


@query("SELECT doc_id, text, lang, source FROM documents")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON with their nulls, and read back."""
    path, docs = scratch(spark), read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    S.sink_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query("SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_acctbal AS VARCHAR) c_acctbal FROM customer")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV with a header, and read back as texts."""
    path = scratch(spark)
    S.sink_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return S.scan_csv_rows(spark, path).drop("path")


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) keys, count(*) n, 'csv' source_format FROM orders")
def scan_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV files, each a record with its rows and format, counted over all files."""
    path = scratch(spark)
    S.sink_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    rows = S.scan_csv_wrapped(spark, path).select(F.explode(F.try_variant_get("record", "$.rows", "array<struct<o_orderkey: string>>")).alias("r"), F.try_variant_get("record", "$._source_format", "string").alias("f"))
    return rows.agg(F.sum(F.col("r.o_orderkey").cast("long")).alias("keys"), F.count("*").alias("n"), F.max("f").alias("source_format"))


@query(AUDIT + "SELECT document_type, count(*) n_reports, count(*) FILTER (is_valid) n_valid, 'run-1' run_ts FROM r GROUP BY 1")
def sink_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit reports saved by type, and counted from what was saved."""
    path = scratch(spark)
    S.sink_reports(V.validate_invoices(invoices(spark, sf_dir)).select("doc_id", "document_type", "is_valid", "score"), path, "run-1")
    return spark.read.parquet(path).groupBy("document_type").agg(F.count("*").alias("n_reports"), F.count_if("is_valid").alias("n_valid"), F.max("run_ts").alias("run_ts"))


@query(AUDIT + "SELECT l_orderkey doc_id, CAST(i AS INT) pos, t / 100.0 total FROM m")
def item_field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of every line item with its place in its record."""
    items = invoices(spark, sf_dir).select("doc_id", F.posexplode("line_items").alias("pos", "item"))
    return items.select("doc_id", "pos", F.col("item.total").alias("total"))


@query("""WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) w, event_type kind, value FROM events), s AS (SELECT w, kind, value FROM b UNION ALL SELECT w - INTERVAL '5 minutes', kind, value FROM b)
SELECT w window_start, kind, count(*) n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) failed_share, round(avg(value), 4) mean_value FROM s GROUP BY 1, 2""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over windows of ten minutes that start every five."""
    from folioq.streaming.rates import stream_rates as rates

    return rates(read(spark, sf_dir, "events"), window="10 minutes", slide="5 minutes")


#: Types whose rules the customers' records try, in turn.
TRIED = ("aadhar_card", "pan_card", "passport", "gst_certificate", "utility_bill", "contract", "land_record", "memo")


@query("""WITH c AS (SELECT c_custkey k, c_custkey % 8 t, c_custkey % 5 = 0 bad FROM customer)
SELECT k doc_id, 'uid_number_format' test_name, NOT bad passed FROM c WHERE t = 0 UNION ALL SELECT k, 'dob_in_past', NOT bad FROM c WHERE t IN (0, 1, 2) UNION ALL SELECT k, 'name_present', true FROM c WHERE t = 0
UNION ALL SELECT k, 'pan_number_format', NOT bad FROM c WHERE t = 1 UNION ALL SELECT k, 'expiry_date_after_issue_date', NOT bad FROM c WHERE t = 2 UNION ALL SELECT k, 'passport_number_present', NOT bad FROM c WHERE t = 2
UNION ALL SELECT k, 'gstin_format', NOT bad FROM c WHERE t = 3 UNION ALL SELECT k, 'gstin_state_code', NOT bad FROM c WHERE t = 3 UNION ALL SELECT k, 'address_present', NOT bad FROM c WHERE t = 0 UNION ALL SELECT k, 'units', NOT bad FROM c WHERE t = 4
UNION ALL SELECT k, 'expiration_date_after_effective_date', NOT bad FROM c WHERE t = 5 UNION ALL SELECT k, 'parties_not_empty', NOT bad FROM c WHERE t = 5 UNION ALL SELECT k, 'area_positive', NOT bad FROM c WHERE t = 6 UNION ALL SELECT k, 'owners_not_empty', true FROM c WHERE t = 6""")
def truth_rules_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth tests of identity cards, certificates, bills, contracts and land records; every fifth record breaks its rules."""
    good = {
        "aadhar_card": '{"uid_number": "1234 5678 9012", "dob": "01/02/1990", "name": "A", "address": {"state": "Goa"}}', "pan_card": '{"pan_number": "ABCPE1234F", "dob": "1990"}', "passport": '{"issue_date": "2020-01-01", "expiry_date": "2030-01-01", "dob": "1990-05-05", "passport_number": "K1"}',
        "gst_certificate": '{"gstin": "27ABCDE1234F1Z5"}', "utility_bill": '{"previous_reading": 10, "current_reading": 25.5, "units_consumed": 15.5}', "contract": '{"effective_date": "2020-01-01", "expiration_date": "31/12/2020", "parties": [{"name": "A"}]}', "land_record": '{"total_area": {"value": 2.5}, "owners": [1]}', "memo": "{}",
    }
    bad = {
        "aadhar_card": '{"uid_number": "1234", "dob": "01/02/2990", "name": "A", "address": {"state": " "}}', "pan_card": '{"pan_number": "AB1234", "dob": "2990"}', "passport": '{"issue_date": "2030-01-01", "expiry_date": "2020-01-01", "dob": "2990-05-05", "passport_number": " "}',
        "gst_certificate": '{"gstin": "00X"}', "utility_bill": '{"previous_reading": 10, "current_reading": 25, "units_consumed": 99}', "contract": '{"effective_date": "2021-01-01", "expiration_date": "31/12/2020", "parties": []}', "land_record": '{"total_area": {"value": 0}, "owners": [1]}', "memo": "{}",
    }
    k = F.col("c_custkey")
    pick = lambda table: F.get(F.array(*[F.lit(table[t]) for t in TRIED]), (k % 8).cast("int"))
    made = read(spark, sf_dir, "customer").select(k.alias("doc_id"), pick({t: t for t in TRIED}).alias("kind"), F.parse_json(F.when(k % 5 == 0, pick(bad)).otherwise(pick(good))).alias("record"))
    tests = truth.truth_rules(F.col("kind"), F.col("record"), F.to_date(F.lit("2024-06-15")))
    return made.select("doc_id", F.inline(tests)).select("doc_id", "test_name", "passed")
