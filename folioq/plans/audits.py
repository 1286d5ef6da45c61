"""Queries that audit orders as invoices, with SQL over the same tables.

Amounts are whole cents before they become numbers, so both sides add them up exactly. Zeros and nulls occur in every operand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import fleet
from folioq.operators import normalise as N
from folioq.operators import validation as V
from folioq.plans.base import query, read
from folioq.plans.texts import WRITTEN, rotated


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, priority, day, subtotal, tax, total, line_items) of every order."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    line = read(spark, sf_dir, "lineitem").withColumns({"ext": cents("l_extendedprice"), "q": F.col("l_quantity").cast("long"), "off": cents("l_discount"), "rate": cents("l_tax")})
    total = F.when(F.col("l_linenumber") % 3 == 0, F.expr("ext * (100 - off) div 100")).otherwise(F.col("ext"))
    quantity = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 53 == 0, 0).otherwise(F.col("q")).cast("double")
    item = F.struct("l_linenumber", quantity.alias("quantity"), (F.expr("ext div q") / 100).alias("unit_price"), (F.col("t") / 100).alias("total"))
    items = line.withColumn("t", total).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("line_items"), F.sum("t").alias("s"), F.sum(F.expr("ext * rate div 100")).alias("x"))
    orders = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    sub = F.when(k % 29 == 0, None).when(k % 31 == 0, F.lit(0)).when(k % 7 == 0, F.expr("s * 9 div 10")).otherwise(F.col("s"))
    tax = F.when(k % 37 == 0, F.lit(0)).otherwise(F.col("x"))
    whole = F.when(k % 4 == 0, cents("o_totalprice")).otherwise(F.col("s") + F.col("x"))
    return orders.select(k.alias("doc_id"), F.col("o_orderpriority").alias("document_type"), F.col("o_orderdate").alias("day"), (sub / 100).alias("subtotal"), (tax / 100).alias("tax"), (whole / 100).alias("total"), "line_items")


def close(a: str, b: str) -> str:
    return f"abs(({a}) - ({b})) <= 0.02 * greatest(abs({a}), abs({b}))"


AUDIT = f"""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) ext, CAST(l_quantity AS BIGINT) q0, CAST(round(l_discount * 100) AS BIGINT) off, CAST(round(l_tax * 100) AS BIGINT) rate FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN 0 ELSE q0 END, ext // q0, CASE WHEN l_linenumber % 3 = 0 THEN ext * (100 - off) // 100 ELSE ext END) - 1 i, CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN 0 ELSE q0 END * (ext // q0) / 100.0 e, ext // q0 p, CASE WHEN l_linenumber % 3 = 0 THEN ext * (100 - off) // 100 ELSE ext END t, ext * rate // 100 x FROM l),
b AS (SELECT *, p <> 0 AND t <> 0 AND NOT ({close('e', 't / 100.0')}) bad FROM m),
g AS (SELECT l_orderkey, count(*) n_items, count(*) FILTER (bad) n_bad, count(*) FILTER (p <> 0 AND t <> 0) n_known, sum(t) s, sum(x) x FROM b GROUP BY 1),
o AS (SELECT o_orderkey k, o_orderpriority document_type, o_orderdate AS day, n_items, n_bad, n_known, s / 100.0 s, CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN s * 9 // 10 ELSE s END / 100.0 sub, CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE x END / 100.0 tax, CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice * 100) ELSE s + x END / 100.0 total FROM orders LEFT JOIN g ON l_orderkey = o_orderkey),
c AS (SELECT *, coalesce(NOT ({close('sub + tax', 'total')}) AND tax <> 0 AND total <> 0, false) bad_total, coalesce(s > 0 AND NOT ({close('sub', 's')}), false) bad_sub, CASE WHEN n_known > 0 THEN n_bad = 0 END t1, CASE WHEN n_items > 0 THEN {close('s', 'sub')} END t2, {close('sub + tax', 'total')} t3 FROM o),
d AS (SELECT *, coalesce(n_bad, 0) + CAST(bad_total AS INT) n_errors, CAST(bad_sub AS INT) + CAST(coalesce(NOT t1, false) AS INT) + CAST(coalesce(NOT t2, false) AS INT) + CAST(coalesce(NOT t3, false) AS INT) n_warnings,
 CAST(t1 IS NOT NULL AS INT) + CAST(t2 IS NOT NULL AS INT) + CAST(t3 IS NOT NULL AS INT) n_tests, CAST(coalesce(t1, false) AS INT) + CAST(coalesce(t2, false) AS INT) + CAST(coalesce(t3, false) AS INT) n_passed FROM c),
v AS (SELECT *, CASE WHEN n_tests > 0 THEN n_passed / n_tests ELSE 1.0 END pass_rate, round(least(1.0, CAST(0.55 AS DOUBLE) * greatest(0.0, 1 / (1 + CAST(0.4 AS DOUBLE) * n_errors) - CAST(0.04 AS DOUBLE) * n_warnings) + CAST(0.45 AS DOUBLE) * (CASE WHEN n_tests > 0 THEN n_passed / n_tests ELSE 1.0 END)), 4) score FROM d),
r AS (SELECT *, n_errors = 0 is_valid, CASE WHEN score>=0.95 THEN 'A+' WHEN score>=0.9 THEN 'A' WHEN score>=0.85 THEN 'B+' WHEN score>=0.8 THEN 'B' WHEN score>=0.75 THEN 'C+' WHEN score>=0.7 THEN 'C' ELSE 'D' END grade FROM v),
f1 AS (SELECT l_orderkey k, 'logical_consistency' pillar, 'error' severity, 'line_items.' || i || '.total' field, 'Quantity × Unit Price ≠ Total' message, printf('%.2f', CAST(e AS DOUBLE)) expected, printf('%.2f', t / 100.0) actual FROM b WHERE bad),
f2 AS (SELECT k, 'logical_consistency' pillar, 'error' severity, 'total' field, 'Subtotal + Tax ≠ Total' message, printf('%.2f', CAST(sub + tax AS DOUBLE)) expected, printf('%.2f', CAST(total AS DOUBLE)) actual FROM c WHERE bad_total),
f3 AS (SELECT k, 'logical_consistency' pillar, 'warning' severity, 'subtotal' field, 'Subtotal ≠ sum of line-item totals' message, printf('%.2f', CAST(s AS DOUBLE)) expected, printf('%.2f', CAST(sub AS DOUBLE)) actual FROM c WHERE bad_sub),
tt AS (SELECT k, 'line_math' test_name, 'quantity * unit_price = total' assertion, t1 passed, CAST(NULL AS VARCHAR) expected_value, CAST(NULL AS VARCHAR) actual_value FROM c WHERE t1 IS NOT NULL
 UNION ALL SELECT k, 'subtotal', 'sum of line totals = subtotal', t2, printf('%.2f', CAST(s AS DOUBLE)), printf('%.2f', CAST(sub AS DOUBLE)) FROM c WHERE t2 IS NOT NULL
 UNION ALL SELECT k, 'total', 'subtotal + tax = total', t3, printf('%.2f', CAST(sub + tax AS DOUBLE)), printf('%.2f', CAST(total AS DOUBLE)) FROM c WHERE t3 IS NOT NULL),
f4 AS (SELECT k, 'truth_test' pillar, 'warning' severity, test_name field, 'Truth test failed: ' || assertion message, expected_value expected, actual_value actual FROM tt WHERE NOT passed)
"""


def findings(df: DataFrame, col: str = "findings") -> DataFrame:
    return df.select("doc_id", F.inline(col))


def found(*parts: str) -> str:
    return AUDIT + " UNION ALL ".join(f"SELECT k doc_id, pillar, severity, field, message, expected, actual FROM {p}" for p in parts)


@query(AUDIT + "SELECT k doc_id, n_errors::BIGINT n_errors, n_warnings::BIGINT n_warnings, round(pass_rate, 4) pass_rate, is_valid, score, grade FROM r")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, truth tests, score and grade of every order as an invoice."""
    report = V.validate_invoices(invoices(spark, sf_dir))
    return report.select("doc_id", "n_errors", "n_warnings", F.round("pass_rate", 4).alias("pass_rate"), "is_valid", "score", "grade")


@query(AUDIT + "SELECT document_type, month(day) AS month, grade, count(*) n_docs, count(*) FILTER (is_valid) n_valid, round(avg(score), 4) mean_score FROM r GROUP BY ROLLUP (1, 2, 3)")
def fleet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, valid ones and mean score by type, month and grade, with all subtotals."""
    report = V.validate_invoices(invoices(spark, sf_dir)).withColumn("month", F.month("day").cast("long"))
    return report.rollup("document_type", "month", "grade").agg(F.count("*").alias("n_docs"), F.count_if("is_valid").alias("n_valid"), fleet.mean_score(F.col("score")).alias("mean_score"))


@query(found("f1"))
def check_line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(invoices(spark, sf_dir).withColumn("findings", V.check_line_math(F.col("line_items"))))


@query(found("f2"))
def check_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(invoices(spark, sf_dir).withColumn("findings", V.check_total(F.col("subtotal"), F.col("tax"), F.col("total"))))


@query(found("f3"))
def check_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(invoices(spark, sf_dir).withColumn("findings", V.check_subtotal(F.col("subtotal"), F.col("line_items"))))


@query(found("f1", "f2", "f3", "f4"))
def union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all checks with the failed truth tests."""
    return findings(V.validate_invoices(invoices(spark, sf_dir)))


@query(found("f1", "f2"))
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of every report."""
    report = V.validate_invoices(invoices(spark, sf_dir))
    return findings(report.withColumn("findings", F.filter("findings", lambda f: f["severity"] == "error")))


@query(found("f4"))
def truth_to_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = V.validate_invoices(invoices(spark, sf_dir))
    return findings(report.withColumn("findings", V.truth_to_findings(F.col("truth_tests"))))


@query(AUDIT + "SELECT k doc_id, test_name, assertion, passed, expected_value, actual_value FROM tt")
def truth_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_invoices(invoices(spark, sf_dir)).select("doc_id", F.inline("truth_tests")).drop("detail")


@query(AUDIT + "SELECT document_type, round(coalesce(sum(n_passed) / nullif(sum(n_tests), 0), 1.0), 4) pass_rate FROM r GROUP BY 1")
def truth_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tests passed by type."""
    tests = V.validate_invoices(invoices(spark, sf_dir)).select("document_type", F.explode_outer("truth_tests").alias("t"))
    return tests.groupBy("document_type").agg(F.round(F.coalesce(F.avg(F.col("t.passed").cast("int")), F.lit(1.0)), 4).alias("pass_rate"))


@query(AUDIT + "SELECT k doc_id, score FROM r")
def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_invoices(invoices(spark, sf_dir)).select("doc_id", "score")


@query(AUDIT + "SELECT k doc_id, is_valid FROM r")
def is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_invoices(invoices(spark, sf_dir)).select("doc_id", "is_valid")


@query(AUDIT + "SELECT k doc_id, round(coalesce(s, 0), 2) line_sum FROM c")
def line_total_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(spark, sf_dir).select("doc_id", F.round(F.coalesce(V.line_total_sum(F.col("line_items")), F.lit(0.0)), 2).alias("line_sum"))


@query(AUDIT + "SELECT k doc_id, n_errors::BIGINT n_errors, n_warnings::BIGINT n_warnings FROM r WHERE n_errors + n_warnings > 0")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of the records that have any."""
    return V.validate_invoices(invoices(spark, sf_dir)).filter("n_errors + n_warnings > 0").select("doc_id", "n_errors", "n_warnings")


@query(AUDIT + """SELECT k extraction_id, CASE WHEN is_valid THEN 'passed' ELSE 'failed' END status, CAST(floor(CAST(score AS DECIMAL(9,4)) * 100) AS INT) quality_score, n_errors + n_warnings n_issues, '{"errors":' || n_errors || ',"warnings":' || n_warnings || '}' metadata FROM r""")
def sink_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue row of every report: status, whole-number score, issues and the counts for the audit log."""
    from folioq.operators.catalogue import validation_rows

    rows = validation_rows(V.validate_invoices(invoices(spark, sf_dir)), "doc_id")
    return rows.select("extraction_id", "status", "quality_score", F.size(F.from_json("issues", f"array<{V.FINDING}>")).cast("long").alias("n_issues"), "metadata")


@query("""SELECT o_custkey doc_id, 'education.' || i || '.graduation_date' field, CAST(y AS VARCHAR) actual FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i, year(o_orderdate) + CASE o_orderkey % 5 WHEN 1 THEN 60 WHEN 2 THEN -60 ELSE 0 END y, o_orderkey k FROM orders) WHERE (y > 2034 OR y < 1950) AND k % 11 <> 0""")
def check_grad_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graduations from orders, some sixty years off and some without a year, checked as of 2024."""
    k = F.col("o_orderkey")
    year = F.year("o_orderdate") + F.when(k % 5 == 1, 60).when(k % 5 == 2, -60).otherwise(0)
    text = F.when(k % 11 == 0, "unknown").otherwise(F.concat(F.lit("May "), year.cast("string")))
    education = F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("graduation_date"))))
    people = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(education.alias("education"))
    return people.select("doc_id", F.inline(V.check_grad_year(F.col("education"), 2024))).select("doc_id", "field", "actual")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records with dates, phones and amounts in changing forms, nested and in a list."""
    k = F.col("o_orderkey")
    digits = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    phone = F.when(k % 3 == 0, F.concat(F.lit("9-"), digits)).when(k % 3 == 1, F.concat(F.lit("+919"), digits)).otherwise("ext")
    whole = F.col("o_totalprice").cast("decimal(18,2)")
    price = F.when(k % 3 == 0, F.concat(F.lit("₹ "), whole.cast("string"))).when(k % 3 == 1, whole.cast("string")).otherwise("Rs. 5")
    record = F.struct(
        rotated(k, F.col("o_orderdate"), WRITTEN).alias("invoice_date"),
        F.struct(F.lit("n").alias("name"), phone.alias("phone")).alias("vendor"),
        F.array(F.struct(price.alias("price"), F.lit("x").alias("note")), F.struct(F.lit("1,000").alias("price"), F.lit("2,5").alias("note"))).alias("line_items"),
    )
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), record.alias("record"))


def changes(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    # a plain inline would have the changes made again for the filter that Spark derives from it
    log = N.normalise(written(spark, sf_dir), "record").select("doc_id", F.inline_outer("changes"))
    return log.filter(F.col("rule_applied") == rule)


@query("""WITH d AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, o_orderkey % 16 f FROM orders), e AS (SELECT k, f, CASE WHEN f IN (1, 3) AND day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END v FROM d WHERE f < 12 OR f = 13)
SELECT k doc_id, 'invoice_date' field, v normalised_value FROM e""")
def normalise_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir, N.DATE_RULE).select("doc_id", "field", "normalised_value")


@query("SELECT o_orderkey doc_id, 'vendor.phone' field, '9-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') original_value, '+919' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') normalised_value FROM orders WHERE o_orderkey % 3 = 0")
def normalise_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir, N.PHONE_RULE).select("doc_id", "field", "original_value", "normalised_value")


@query("""SELECT o_orderkey doc_id, 'line_items.0.price' field, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) amount FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'line_items.1.price', 1000.0 FROM orders""")
def normalise_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount texts with signs or commas, as numbers; plain ones and others stay."""
    return changes(spark, sf_dir, N.AMOUNT_RULE).select("doc_id", "field", F.col("normalised_value").cast("double").alias("amount"))
