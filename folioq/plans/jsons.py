"""Queries over JSON replies, made from events and line items, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions import json as J
from folioq.operators import chunks as K
from folioq.operators import exports as X
from folioq.plans.base import query, read
from folioq.plans.records import SCHEMAS, number, shown, typed
from folioq.registry import leaves


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their props as a reply: plain, fenced, inside prose, broken, or missing."""
    k, p = F.col("event_id") % 5, F.coalesce("props", F.lit("{}"))
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), p, F.lit(" - done"))).when(k == 3, F.concat(p, F.lit("}")))
    return read(spark, sf_dir, "events").select("event_id", text.alias("reply"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(coalesce(props, '{}'), '$.k') AS BIGINT) END k FROM events")
def parse_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("event_id", F.try_variant_get(J.parse_json_object(F.col("reply")), "$.k", "bigint").alias("k"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies with a list: plain, fenced, a lone object, inside prose with a second list, or nothing."""
    k, e = F.col("event_id") % 5, F.col("event_id").cast("string")
    one = F.concat(F.lit('{"test_name": "t'), e, F.lit('", "passed": true, "severity": "ERROR", "field": "f", "message": "m'), e, F.lit('", "expected_value": '), e, F.lit("}"))
    two = F.concat(F.lit("["), one, F.lit(', 7, {"severity": "odd", "actual_value": "x"}]'))
    text = F.when(k == 0, two).when(k == 1, F.concat(F.lit("```json\n"), two, F.lit("\n```"))).when(k == 2, one).when(k == 3, F.concat(F.lit("see "), two, F.lit(" and [1]"))).otherwise("nothing here")
    return read(spark, sf_dir, "events").select("event_id", text.alias("reply"))


@query("SELECT event_id, CASE event_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 0 ELSE 3 END n_items FROM events")
def parse_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("event_id", F.size(J.parse_json_array(F.col("reply"))).alias("n_items"))


@query("""SELECT event_id, 'error' severity, 'f' field, 'm' || event_id message, CAST(event_id AS VARCHAR) expected, CAST(NULL AS VARCHAR) actual FROM events WHERE event_id % 5 < 4
UNION ALL SELECT event_id, 'warning', NULL, 'Contextual sanity issue', NULL, 'x' FROM events WHERE event_id % 5 IN (0, 1, 3)""")
def issue_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("event_id", F.inline(J.issue_ingest(F.col("reply")))).drop("pillar")


@query("""SELECT event_id, 't' || event_id test_name, true passed, CAST(event_id AS VARCHAR) expected_value, CAST(NULL AS VARCHAR) actual_value FROM events WHERE event_id % 5 < 4
UNION ALL SELECT event_id, 'unnamed_test', false, NULL, 'x' FROM events WHERE event_id % 5 IN (0, 1, 3)""")
def truth_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("event_id", F.inline(J.truth_ingest(F.col("reply")))).drop("assertion", "detail")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type ELSE 'other' END document_type, CASE WHEN event_id % 3 = 0 THEN (event_id % 100) / 100.0 ELSE 0.0 END confidence FROM events")
def classification_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a type and a confidence, with a type only, and without a type."""
    k = F.col("event_id") % 3
    said = F.to_json(F.struct(F.when(k < 2, F.col("event_type")).alias("document_type"), F.when(k == 0, F.col("event_id") % 100 / 100).alias("confidence")))
    made = read(spark, sf_dir, "events").select("event_id", J.classification_ingest(F.concat(F.lit("```\n"), said, F.lit("\n```"))).alias("c"))
    return made.select("event_id", "c.document_type", "c.confidence")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of a record: a chunk per line number, with fields that are null or empty here and there."""
    k = F.col("l_partkey")
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    name = F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(F.concat(F.lit("n"), k.cast("string")))
    return line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk"), name.alias("name"), F.when(k % 2 == 0, k).alias("number"), F.array(F.col("flag"), F.col("status"), F.col("flag")).alias("tags"))


CHUNKS = """WITH c AS (SELECT l_orderkey doc_id, l_linenumber chunk, min(l_partkey) k, min(l_returnflag) f, min(l_linestatus) s FROM lineitem GROUP BY 1, 2),
m AS (SELECT doc_id, arg_min(CASE WHEN k % 3 = 2 THEN 'n' || k END, CASE WHEN k % 3 = 2 THEN chunk END) AS name, arg_min(CASE WHEN k % 2 = 0 THEN k END, CASE WHEN k % 2 = 0 THEN chunk END) number, count(*) n FROM c GROUP BY 1),
i AS (SELECT doc_id, chunk, 0 pos, f item FROM c UNION ALL SELECT doc_id, chunk, 1, s FROM c UNION ALL SELECT doc_id, chunk, 2, f FROM c),
w AS (SELECT *, min(chunk) OVER (PARTITION BY doc_id, item) first FROM i),
u AS (SELECT doc_id, string_agg(item, ',' ORDER BY chunk, pos) tags FROM w WHERE chunk = first GROUP BY 1)
"""


@query(CHUNKS + "SELECT doc_id, name, number FROM m")
def chunk_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_merge_first(chunked(spark, sf_dir), "doc_id", "chunk", ["name", "number"])


@query(CHUNKS + "SELECT doc_id, tags FROM u")
def chunk_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = chunked(spark, sf_dir).select("doc_id", "chunk", F.posexplode("tags").alias("pos", "item"))
    return K.chunk_list_union(items, "doc_id", "chunk", "pos", "item").select("doc_id", F.array_join("items", ",").alias("tags"))


@query(CHUNKS + "SELECT doc_id, name, number, tags, true _chunked_extraction, n _chunks_processed FROM m JOIN u USING (doc_id)")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.merge_records(chunked(spark, sf_dir), "doc_id", "chunk", ["name", "number"], ["tags"])
    return out.withColumn("tags", F.array_join("tags", ","))


@query(CHUNKS + """, e AS (SELECT doc_id, arg_max_null(CASE WHEN k % 3 = 1 THEN '' END, chunk) AS last FROM c GROUP BY 1)
SELECT doc_id, coalesce(name, last) AS name, number, coalesce(name, last) inner_name, tags inner_tags, tags deep_tags, n _chunks_processed FROM m JOIN u USING (doc_id) JOIN e USING (doc_id)""")
def merge_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with objects in objects, merged at every depth; lists of objects are told apart by what they hold."""
    tags = F.transform("tags", lambda t: F.struct(t.alias("tag")))
    inner = F.struct(F.col("name").alias("name"), F.col("tags").alias("tags"), F.struct(tags.alias("list")).alias("deep"))
    chunks = chunked(spark, sf_dir).select("doc_id", "chunk", F.struct("name", "number", inner.alias("inner")).alias("record"))
    out = K.merge_nested(chunks, "doc_id", "chunk", "record")
    shown = lambda c: F.array_join(c, ",")
    return out.select("doc_id", "record.name", "record.number", F.col("record.inner.name").alias("inner_name"), shown("record.inner.tags").alias("inner_tags"), shown("record.inner.deep.list.tag").alias("deep_tags"), "_chunks_processed")


FLAT = [(path, kind) for path, kind in leaves(SCHEMAS["gst_certificate"]) if path[-1] != "additional_places"]


def flat_sql(path: tuple[str, ...], kind: object) -> str:
    label = " > ".join(map(X.label, path))
    text = f"list_aggregate(list_transform(range(0, (k + {number('gst_certificate')[path]}) % 4), lambda i: '{path[-1]} ' || k || ' ' || i), 'string_agg', '; ')" if isinstance(kind, list) else shown("gst_certificate", ".".join(path))
    return f"SELECT k doc_id, '{label}' AS label, coalesce({text}, '') AS value FROM (SELECT c_custkey k FROM customer)"


@query(" UNION ALL ".join(flat_sql(p, k) for p, k in FLAT))
def flatten_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and values of a nested record; a list of texts is joined."""
    fields = {k: v for k, v in SCHEMAS["gst_certificate"].items() if k != "additional_places"}
    rows: list[Column] = X.rows_of("", fields, F.col("record"), F.lit(0))
    return typed(spark, sf_dir, "gst_certificate").select("doc_id", F.inline(F.array(*rows))).select("doc_id", F.col("key").alias("label"), "value")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'classified' WHEN 2 THEN 'plain' END resolved FROM events")
def resolve_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that is given, else the classification's, else the record's own."""
    from folioq.operators.envelopes import resolve_type as resolve

    k = F.col("event_id") % 4
    text = F.when(k <= 1, '{"classification": {"document_type": "classified"}, "document_type": "plain"}').when(k == 2, '{"document_type": "plain"}').otherwise("{}")
    return read(spark, sf_dir, "events").select("event_id", resolve(F.when(k == 0, "given"), F.parse_json(text)).alias("resolved"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN 'null' ELSE '{\"b\":2}' END payload FROM events")
def resolve_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structured_data if that key is there, null or not, else the whole record."""
    from folioq.operators.envelopes import resolve_payload as resolve

    k = F.col("event_id") % 3
    text = F.when(k == 0, '{"structured_data": {"a": 1}, "b": 2}').when(k == 1, '{"structured_data": null}').otherwise('{"b": 2}')
    return read(spark, sf_dir, "events").select("event_id", F.to_json(resolve(F.parse_json(text))).alias("payload"))
