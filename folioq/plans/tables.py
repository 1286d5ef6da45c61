"""Queries over tables made from orders and readings made from events, with SQL from the same rule.

The table of order k has k mod 4 rows below its headers and 1 + k mod 3 columns; cell (r, c) is null where k + 3r + c is a
multiple of 7, else empty where it is one of 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import tables as T
from folioq.plans.base import query, read


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "case when (o_orderkey + r * 3 + c) % 7 = 0 then null when (o_orderkey + r * 3 + c) % 5 = 0 then ' ' else concat('v', r % 2, c) end"
    raw = F.expr(f"transform(sequence(0, cast(o_orderkey % 4 as int)), r -> transform(sequence(0, cast(o_orderkey % 3 as int)), c -> {cell}))")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), T.normalise_table(raw).alias("table"))


CELL = "CASE WHEN (k + r * 3 + c) % 7 = 0 THEN '' WHEN (k + r * 3 + c) % 5 = 0 THEN ' ' ELSE 'v' || r % 2 || c END"
TABLES = f"""WITH o AS (SELECT o_orderkey k, o_custkey d, o_orderkey % 4 n, 1 + o_orderkey % 3 w FROM orders), x AS (SELECT k, unnest(range(0, n + 1)) r, w FROM o), y AS (SELECT k, r, unnest(range(0, w)) c FROM x), z AS (SELECT k, r, c, {CELL} v FROM y),
s AS (SELECT k, count(*) FILTER (r = 0 AND trim(v) = '') eh, count(*) FILTER (r > 0 AND trim(v) = '') ec, string_agg(CASE WHEN r = 0 THEN v END, '|' ORDER BY c) h, string_agg(CASE WHEN r = 0 AND c < 3 THEN v END, '|' ORDER BY c) h3 FROM z GROUP BY 1),
t AS (SELECT o.*, eh, ec, h, h3, n >= 1 AND w >= 2 shape FROM o JOIN s USING (k)), u AS (SELECT *, row_number() OVER (PARTITION BY d, n, w, h3 ORDER BY k) j FROM t)
"""


@query(TABLES + "SELECT k ord, h headers, CAST(n AS INT) row_count, CAST(w AS INT) col_count, CAST(n AS INT) n_maps FROM t")
def normalise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("ord", F.array_join("table.headers", "|").alias("headers"), "table.row_count", "table.col_count", F.size("table.data").alias("n_maps"))


@query(TABLES + "SELECT k ord, CAST(eh AS INT) empty_headers, CAST(ec AS INT) empty_cells, CAST(n * w AS INT) total_cells FROM t")
def table_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("ord", T.table_cell_stats(F.col("table")).alias("s")).select("ord", "s.*")


@query(TABLES + "SELECT k ord, shape AND eh <= w * 0.5 AND NOT (n * w > 0 AND ec > 0.8 * n * w) is_table FROM t")
def validate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("ord", T.validate_table(F.col("table")).alias("is_table"))


@query(TABLES + "SELECT k ord, shape is_table FROM t")
def validate_docx_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("ord", T.validate_docx_table(F.col("table")).alias("is_table"))


@query(TABLES + "SELECT d doc_id, k ord FROM u WHERE j = 1")
def table_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table_dedup(tables(spark, sf_dir), "doc_id", "ord").select("doc_id", "ord")


@query(TABLES + "SELECT d doc_id, k ord, CAST(row_number() OVER (PARTITION BY d ORDER BY k) AS INT) table_num FROM u WHERE j = 1")
def table_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table_dedup(tables(spark, sf_dir), "doc_id", "ord").select("doc_id", "ord", "table_num")


@query(TABLES + "SELECT k ord, string_agg(CASE WHEN r = 0 THEN v END, '|' ORDER BY c) headers, coalesce(string_agg(CASE WHEN r > 0 THEN v END, '|' ORDER BY r, c), '') cells FROM z GROUP BY 1")
def image_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and cells of detected tables, nulls as empty texts."""
    return tables(spark, sf_dir).select("ord", F.array_join("table.headers", "|").alias("headers"), F.array_join(F.flatten("table.rows"), "|").alias("cells"))


@query("WITH f AS (SELECT o_custkey d, o_orderkey k FROM orders WHERE o_orderpriority LIKE '1%') SELECT d doc_id, k ord, 'first' reader FROM f UNION ALL SELECT o_custkey, o_orderkey, 'second' FROM orders WHERE o_orderpriority LIKE '2%' AND o_custkey NOT IN (SELECT d FROM f)")
def union_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as one reader's tables, high ones as the other's."""
    orders = read(spark, sf_dir, "orders")
    part = lambda p, name: orders.filter(F.col("o_orderpriority").startswith(p)).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.lit(name).alias("reader"))
    return T.union_backends(part("1", "first"), part("2", "second"), "doc_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells: a table per order, spans from the part's key."""
    k = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (k % 5).alias("col"), F.when(k % 6 == 0, 2).otherwise(1).alias("row_span"), F.when(k % 10 == 0, 3).otherwise(1).alias("col_span"))


SPANS = "(SELECT l_orderkey % 500 doc_id, l_orderkey table_id, l_linenumber r, l_partkey % 5 c, CASE WHEN l_partkey % 6 = 0 THEN 2 ELSE 1 END rs, CASE WHEN l_partkey % 10 = 0 THEN 3 ELSE 1 END cs FROM lineitem)"


@query(f"SELECT doc_id, table_id, count(*) total_cells, count(*) FILTER (rs > 1 OR cs > 1) merged_cells, count(*) FILTER (rs > 1 OR cs > 1) > 0 has_merged_cells FROM {SPANS} GROUP BY 1, 2")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merge_stats(cells(spark, sf_dir), ["doc_id", "table_id"])


@query(f"SELECT doc_id, count(*) FILTER (m) tables_with_merged_cells FROM (SELECT doc_id, table_id, bool_or(rs > 1 OR cs > 1) m FROM {SPANS} GROUP BY 1, 2) GROUP BY 1")
def doc_merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.doc_merge_tables(T.merge_stats(cells(spark, sf_dir), ["doc_id", "table_id"]), "doc_id")


@query(f"SELECT doc_id, table_id, r start_row, c start_col, r + rs - 1 end_row, c + cs - 1 end_col, rs * cs cell_count FROM {SPANS} WHERE rs > 1 OR cs > 1")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merged_regions(cells(spark, sf_dir), ["doc_id", "table_id"])


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of pages, in the order of their ids."""
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), k.alias("try_no"), (k * 37 % 101).alias("confidence"), (k * 53 % 500).alias("chars"))


@query("""WITH t AS (SELECT user_id page, event_id n, event_id * 37 % 101 c, event_id * 53 % 500 s FROM events), m AS (SELECT *, max(c) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) b FROM t),
g AS (SELECT *, first_value(s) OVER (PARTITION BY page, b ORDER BY CASE WHEN c = b THEN 0 ELSE 1 END, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) bs FROM m),
e AS (SELECT page, min(n) stop FROM g WHERE b >= 85 AND bs >= 250 GROUP BY 1), l AS (SELECT t.* FROM t LEFT JOIN e USING (page) WHERE stop IS NULL OR n <= stop)
SELECT page, arg_max(n, c * 1000000000 - n) try_no, max(c) confidence, arg_max(s, c * 1000000000 - n) chars FROM l GROUP BY 1""")
def best_ocr_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_ocr_candidate(tries(spark, sf_dir))


@query("SELECT user_id page, round(coalesce(avg(CASE WHEN event_id % 50 - 5 > 0 THEN event_id % 50 - 5 END), 0), 4) mean_confidence FROM events GROUP BY 1")
def ocr_page_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50 - 5).alias("confidence"))
    return T.ocr_page_mean(words, "user_id", "confidence").select(F.col("user_id").alias("page"), F.round("mean_confidence", 4).alias("mean_confidence"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) v FROM events), b AS (SELECT *, sum(coalesce(v, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END bal FROM e)
SELECT event_id, user_id, abs(coalesce(lag(bal) OVER (PARTITION BY user_id ORDER BY ts, event_id), bal - coalesce(v, 0)) + coalesce(v, 0) - bal) <= 1 follows FROM b""")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an account: balances in cents, some off by five."""
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events").withColumn("v", F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)))
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stated = events.withColumn("balance", (F.sum("v").over(so_far) + F.when(F.col("event_id") % 97 == 0, 5).otherwise(0)) / 100.0).withColumn("amount", F.col("v") / 100.0)
    return T.running_balance(stated, "user_id", ["ts", "event_id"], "amount", "balance").select("event_id", "user_id", (F.abs(F.round(F.col("expected_balance") * 100) - F.round(F.col("balance") * 100)) <= 1).alias("follows"))
