"""The audit of records of any type: customers in turn hold a record of each type, every fifth of which breaks its rules.

The SQL says what each record must give, written down by hand from the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators.audit import audit
from folioq.plans.base import query, read

#: Type, a record that is right, one that isn't.
CASES = (
    ("invoice", '{"line_items": [{"quantity": 2, "unit_price": 50.5, "total": 101}, {"quantity": 1, "unit_price": "x", "total": 9}, 7], "subtotal": 110, "tax": 10, "total": 120, "invoice_date": "03/04/2024"}', '{"line_items": [{"quantity": 2, "unit_price": 50, "total": 150}], "subtotal": 100, "tax": 10, "total": 200}'),
    (
        "invoice",
        '{"items": [{"quantity": "3", "rate": "₹ 1,000", "amount": "3,000.00"}], "subtotal": "₹3,000", "tax_amount": "300", "grand_total": "3 300", "due_date": "2024-05-01", "vendor": {"phone": "98765 43210"}}',
        '{"items": [{"quantity": "3", "rate": 0, "price": "10", "total": 0, "amount": "31"}], "subtotal": "31", "tax": 0, "tax_amount": 5, "total": null, "grand_total": "40"}',
    ),
    (
        "resume",
        '{"experience": [{"start_date": "2020-01-01", "end_date": "Present"}, {"start_date": "01/02/2018", "end_date": "2019-12-31"}], "education": [{"graduation_date": "May 2017"}, {"end_date": "1990"}]}',
        '{"experience": [{"start_date": "2021-01-01", "end_date": "2019-01-01"}], "education": [{"graduation_date": "2050"}, {"graduation_date": "", "end_date": "1900"}]}',
    ),
    ("bank_statement", '{"opening_balance": "1,000.50", "closing_balance": 900.5, "transactions": [{"debit": 200, "balance": 800.5}, {"credit": "100", "balance": "900.50"}]}', '{"opening_balance": 1000, "closing_balance": 5, "transactions": [{"debit": 200, "balance": 900}]}'),
    ("contract", '{"effective_date": "2020-01-01", "expiration_date": "31/12/2020", "parties": [{"name": "A"}], "payment_terms": {"amount": "$ 5"}}', '{"effective_date": "2021-01-01", "expiration_date": "2020-12-31", "parties": [], "payment_terms": {"amount": 0}}'),
    ("prescription", '{"date": "2024-01-05", "medicines": [{"dosage": "500 mg"}, {"dosage": "as needed"}]}', '{"date": "2034-01-05", "medicines": [{"dosage": "-5 mg"}]}'),
    ("aadhar_card", '{"uid_number": "1234 5678 9012", "dob": "01/02/1990", "name": "A", "address": {"state": "Goa"}}', '{"uid_number": "1234", "dob": "2990-02-01", "name": " ", "address": {"state": ""}}'),
    ("cheque", '{"amount_words": "Rupees One Lakh Twenty-Five Thousand Only", "amount_figures": "1,25,000.00", "date": "2024-05-01"}', '{"amount_words": "Rupees Fifty Only", "amount_figures": 51, "date": "01/01/2020"}'),
    ("memo", '{"x": 1, "subtotal": 5, "tax": 1, "total": 9}', '{"note": "n"}'),
)
AS_OF = "2024-06-15"
#: (case, broken, errors, warnings, tests, tests passed, changes) without the model's findings.
EXPECTED = """(0, false, 0, 0, 3, 3, 1), (0, true, 2, 4, 3, 0, 0), (1, false, 0, 0, 3, 3, 4), (1, true, 2, 2, 3, 1, 0), (2, false, 0, 0, 2, 2, 1), (2, true, 0, 4, 2, 0, 0),
(3, false, 0, 0, 2, 2, 0), (3, true, 0, 2, 2, 0, 0), (4, false, 0, 0, 3, 3, 2), (4, true, 0, 3, 3, 0, 0), (5, false, 0, 0, 3, 3, 0), (5, true, 0, 2, 3, 1, 0),
(6, false, 0, 0, 4, 4, 1), (6, true, 0, 4, 4, 0, 0), (7, false, 0, 0, 2, 2, 1), (7, true, 0, 2, 2, 0, 1), (8, false, 1, 0, 0, 0, 0), (8, true, 0, 0, 0, 0, 0)"""
KEYS = f"(SELECT c_custkey k, c_custkey % {len(CASES)} t, c_custkey % 5 = 0 broken, c_custkey % 4 reply FROM customer)"
COUNTED = f"""SELECT k, t, n_errors + CAST(reply = 1 AS INT) n_errors, n_warnings + CAST(reply = 2 AS INT) n_warnings, n_tests, n_changes, CASE WHEN n_tests > 0 THEN n_passed / n_tests ELSE 1.0 END pass_rate
FROM {KEYS} JOIN (VALUES {EXPECTED}) AS e(t, broken, n_errors, n_warnings, n_tests, n_passed, n_changes) USING (t, broken)"""
KINDS = "CASE t " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(CASES)) + " END"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_type, record, reply) of every customer; the reply is what a model found."""
    k = F.col("c_custkey")
    turn = (k % len(CASES)).cast("int")
    held = lambda i: F.get(F.array(*[F.lit(c[i]) for c in CASES]), turn)
    reply = F.when(k % 4 == 1, '```json\n[{"severity": "ERROR", "field": "f", "message": "m", "expected_value": 1}]\n```').when(k % 4 == 2, '[{"message": "w"}, 5]').when(k % 4 == 3, "nothing to say")
    kind = F.when(k % 2 == 0, F.upper(held(0))).otherwise(held(0))
    return read(spark, sf_dir, "customer").select(k.alias("doc_id"), kind.alias("document_type"), F.parse_json(F.when(k % 5 == 0, held(2)).otherwise(held(1))).alias("record"), reply.alias("reply"))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mixed(spark, sf_dir), F.to_date(F.lit(AS_OF)), replies="reply")


@query(f"""WITH c AS ({COUNTED}), s AS (SELECT *, round(least(1.0, CAST(0.55 AS DOUBLE) * greatest(0.0, 1 / (1 + CAST(0.4 AS DOUBLE) * n_errors) - CAST(0.04 AS DOUBLE) * n_warnings) + CAST(0.45 AS DOUBLE) * pass_rate), 4) score FROM c)
SELECT k doc_id, {KINDS} document_type, n_errors::BIGINT n_errors, n_warnings::BIGINT n_warnings, n_tests::BIGINT n_tests, n_changes::BIGINT n_changes, round(pass_rate, 4) pass_rate, n_errors = 0 is_valid, score,
CASE WHEN score >= 0.95 THEN 'A+' WHEN score >= 0.9 THEN 'A' WHEN score >= 0.85 THEN 'B+' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.75 THEN 'C+' WHEN score >= 0.7 THEN 'C' ELSE 'D' END grade FROM s""")
def audit_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all four pillars, truth tests, changes, score and grade of records of nine kinds."""
    size = lambda c: F.size(c).cast("long").alias(f"n_{c.removeprefix('truth_')}")
    return audited(spark, sf_dir).select("doc_id", F.lower("document_type").alias("document_type"), "n_errors", "n_warnings", size("truth_tests"), size("changes"), F.round("pass_rate", 4).alias("pass_rate"), "is_valid", "score", "grade")


FOUND = """(0, true, 'error', 'line_items.0.total', 'Quantity × Unit Price ≠ Total', '100.00', '150.00'), (0, true, 'error', 'total', 'Subtotal + Tax ≠ Total', '110.00', '200.00'), (0, true, 'warning', 'subtotal', 'Subtotal ≠ sum of line-item totals', '150.00', '100.00'),
(1, true, 'error', 'line_items.0.total', 'Quantity × Unit Price ≠ Total', '30.00', '31.00'), (1, true, 'error', 'total', 'Subtotal + Tax ≠ Total', '36.00', '40.00'),
(2, true, 'warning', 'education.0.graduation_date', 'Graduation year looks unrealistic', NULL, '2050'), (2, true, 'warning', 'education.1.graduation_date', 'Graduation year looks unrealistic', NULL, '1900'), (8, false, 'error', 'total', 'Subtotal + Tax ≠ Total', '6.00', '9.00')"""


@query(f"""SELECT k doc_id, 'logical_consistency' pillar, severity, field, message, expected, actual FROM {KEYS} JOIN (VALUES {FOUND}) AS f(t, broken, severity, field, message, expected, actual) USING (t, broken)
UNION ALL SELECT k, 'contextual_sanity', CASE reply WHEN 1 THEN 'error' ELSE 'warning' END, CASE reply WHEN 1 THEN 'f' END, CASE reply WHEN 1 THEN 'm' ELSE 'w' END, CASE reply WHEN 1 THEN '1' END, NULL FROM {KEYS} WHERE reply IN (1, 2)""")
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that come from arithmetic and from the model."""
    return audited(spark, sf_dir).select("doc_id", F.inline_outer("findings")).filter("pillar <> 'truth_test'")


TESTS = """(0, 'line_math', false), (0, 'subtotal', false), (0, 'total', false), (1, 'line_math', false), (1, 'subtotal', true), (1, 'total', false), (2, 'jobs_in_order', false), (2, 'graduation_realistic', false), (3, 'closing', false), (3, 'running_balance', false),
(4, 'expiration_date_after_effective_date', false), (4, 'value_positive', false), (4, 'parties_not_empty', false), (5, 'date_in_past', false), (5, 'medicines_not_empty', true), (5, 'dosage_positive', false),
(6, 'uid_number_format', false), (6, 'dob_in_past', false), (6, 'name_present', false), (6, 'address_present', false), (7, 'amount_in_words', false), (7, 'date_recent', false)"""


@query(f"SELECT k doc_id, test_name, CASE WHEN broken THEN if_broken ELSE true END passed FROM {KEYS} JOIN (VALUES {TESTS}) AS x(t, test_name, if_broken) USING (t)")
def audit_truth_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every truth test of every record: right records pass all of theirs."""
    return audited(spark, sf_dir).select("doc_id", F.inline_outer("truth_tests")).select("doc_id", "test_name", "passed").filter("test_name is not null")


CHANGED = """(0, false, 'invoice_date', '2024-04-03'), (1, false, 'items.0.amount', '3000.0'), (1, false, 'subtotal', '3000.0'), (1, false, 'grand_total', '3300.0'), (1, false, 'vendor.phone', '+919876543210'), (2, false, 'experience.1.start_date', '2018-02-01'),
(4, false, 'expiration_date', '2020-12-31'), (4, false, 'payment_terms.amount', '5.0'), (6, false, 'dob', '1990-02-01'), (7, false, 'amount_figures', '125000.0'), (7, true, 'date', '2020-01-01')"""


@query(f"SELECT k doc_id, field, normalised_value FROM {KEYS} JOIN (VALUES {CHANGED}) AS c(t, broken, field, normalised_value) USING (t, broken)")
def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What normalisation changes in records of any shape."""
    return audited(spark, sf_dir).select("doc_id", F.inline_outer("changes")).select("doc_id", "field", "normalised_value").filter("field is not null")
