"""Checks of records, their findings, and the score of an audit.

An invoice has subtotal, tax, total and line_items, an array of (quantity, unit_price, total). Every check is an array expression
that gives findings, so nothing is shuffled once the items of a record are together. Prices, item totals, tax and total of zero
count as unknown; a quantity or subtotal of zero is a known value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.values import confidence_grade, is_close
from folioq.functions.variants import bound

FINDING = "struct<pillar: string, severity: string, field: string, message: string, expected: string, actual: string>"
TEST = "struct<test_name: string, assertion: string, passed: boolean, detail: string, expected_value: string, actual_value: string>"
LOGICAL, TRUTH = "logical_consistency", "truth_test"


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def amount_text(x: Column) -> Column:
    """An amount with two decimals."""
    return F.format_string("%.2f", x.cast("double"))


def finding(severity: str, field: Column, message: Column | str, expected: Column | None = None, actual: Column | None = None, pillar: str = LOGICAL) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(F.lit(pillar).alias("pillar"), F.lit(severity).alias("severity"), field.alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (text if expected is None else expected).alias("expected"), (text if actual is None else actual).alias("actual"))


def known(x: Column) -> Column:
    """Zero falls through as unknown."""
    return F.when(x != 0, x)


def line_total_sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0)))


def check_line_math(items: Column) -> Column:
    """An error for every item whose quantity times price is not its total within 2 %."""

    def check(x: Column, i: Column) -> Column:
        expected, total = F.round(x["quantity"] * known(x["unit_price"]), 2), known(x["total"])
        field = F.concat(F.lit("line_items."), i.cast("string"), F.lit(".total"))
        return F.when(~is_close(expected, total), finding("error", field, "Quantity × Unit Price ≠ Total", amount_text(expected), amount_text(total)))

    return F.coalesce(F.array_compact(F.transform(items, check)), none(FINDING))


def when_true(condition: Column, entry: Column, kind: str = FINDING) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(entry)).otherwise(none(kind))


def check_total(subtotal: Column, tax: Column, total: Column) -> Column:
    """An error if subtotal and tax miss the total; skipped if one is unknown, and zero tax is."""
    expected = F.round(subtotal + known(tax), 2)
    return when_true(~is_close(expected, known(total)), finding("error", F.lit("total"), "Subtotal + Tax ≠ Total", amount_text(expected), amount_text(total)))


def check_subtotal(subtotal: Column, items: Column) -> Column:
    """A warning if the items' sum is positive and misses the subtotal."""
    return bound(line_total_sum(items), lambda lines: subtotal_finding(subtotal, lines))


def subtotal_finding(subtotal: Column, lines: Column) -> Column:
    return when_true((lines > 0) & ~is_close(subtotal, lines), finding("warning", F.lit("subtotal"), "Subtotal ≠ sum of line-item totals", amount_text(lines), amount_text(subtotal)))


def check_grad_year(education: Column, as_of_year: int) -> Column:
    """A warning for every graduation year before 1950 or more than ten years ahead of the year given."""

    def check(x: Column, i: Column) -> Column:
        year = F.nullif(F.regexp_extract(x["graduation_date"], r"(\d{4})", 1), F.lit("")).cast("int")
        return F.when((year > as_of_year + 10) | (year < 1950), finding("warning", F.concat(F.lit("education."), i.cast("string"), F.lit(".graduation_date")), "Graduation year looks unrealistic", None, year.cast("string")))

    return F.coalesce(F.array_compact(F.transform(education, check)), none(FINDING))


def truth_test(name: str, assertion: str, passed: Column, expected: Column | None = None, actual: Column | None = None) -> Column:
    """A test that is left out where its operands are unknown."""
    text = F.lit(None).cast("string")
    return F.when(passed.isNotNull(), F.struct(F.lit(name).alias("test_name"), F.lit(assertion).alias("assertion"), passed.alias("passed"), text.alias("detail"), (text if expected is None else expected).alias("expected_value"), (text if actual is None else actual).alias("actual_value")))


def truth_rules_invoice(subtotal: Column, tax: Column, total: Column, items: Column, lines: Column) -> Column:
    """The arithmetic of an invoice as tests; lines is the sum of the items' totals. Products are taken at two decimals, as check_line_math takes them."""
    checkable = F.filter(items, lambda x: (x["quantity"] * known(x["unit_price"]) * known(x["total"])).isNotNull())
    in_line = bound(checkable, lambda found: F.when(F.size(found) > 0, F.forall(found, lambda x: is_close(F.round(x["quantity"] * x["unit_price"], 2), x["total"]))))
    tests = F.array(
        bound(in_line, lambda passed: truth_test("line_math", "quantity * unit_price = total", passed)),
        truth_test("subtotal", "sum of line totals = subtotal", F.when(F.size(items) > 0, is_close(lines, subtotal)), amount_text(lines), amount_text(subtotal)),
        truth_test("total", "subtotal + tax = total", is_close(subtotal + tax, total), amount_text(subtotal + tax), amount_text(total)),
    )
    return F.array_compact(tests)


def truth_rules_statement(opening: Column, closing: Column, transactions: Column) -> Column:
    """A bank statement: the balances at its ends, and from each transaction to the next."""
    moved = F.aggregate(transactions, F.lit(0.0), lambda a, x: a + F.coalesce(x["credit"], F.lit(0.0)) - F.coalesce(x["debit"], F.lit(0.0)))
    before = F.concat(F.array(opening), F.transform(transactions, lambda x: x["balance"]))
    steps = F.transform(transactions, lambda x, i: F.coalesce(F.abs(F.get(before, i) + F.coalesce(x["credit"], F.lit(0.0)) - F.coalesce(x["debit"], F.lit(0.0)) - x["balance"]) <= 0.01, F.lit(True)))
    return F.array_compact(F.array(truth_test("closing", "opening + credits - debits = closing", F.abs(opening + moved - closing) <= 0.01, amount_text(opening + moved), amount_text(closing)), truth_test("running_balance", "each balance follows from the one before", F.when(F.size(transactions) > 0, F.forall(steps, lambda s: s)))))


def truth_pass_rate(tests: Column) -> Column:
    """Share of tests passed; 1 without tests."""
    return F.when(F.size(tests) > 0, F.size(F.filter(tests, lambda t: t["passed"])) / F.size(tests)).otherwise(1.0)


def truth_to_findings(tests: Column) -> Column:
    """A warning for every failed test."""
    failed = F.filter(tests, lambda t: ~t["passed"])
    return F.transform(failed, lambda t: finding("warning", t["test_name"], F.concat(F.lit("Truth test failed: "), t["assertion"]), t["expected_value"], t["actual_value"], TRUTH))


def severity_count(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity)).cast("long")


def validation_score(errors: Column, warnings: Column, passed: Column | float = 1.0) -> Column:
    """55 % for few findings and 45 % for the share of truth tests passed, four decimals."""
    left = F.greatest(F.lit(0.0), 1 / (1 + 0.4 * errors) - 0.04 * warnings)
    return F.round(F.least(F.lit(1.0), 0.55 * left + 0.45 * passed), 4)


def validate_invoices(records: DataFrame) -> DataFrame:
    """records with findings, truth_tests, n_errors, n_warnings, pass_rate, is_valid, score and grade. Null items count as none.

    Every part is bound before others refer to it, so each is evaluated once.
    """
    given = F.struct(F.coalesce(F.col("line_items"), F.array().cast(records.schema["line_items"].dataType)).alias("items"), F.col("subtotal").alias("subtotal"), F.col("tax").alias("tax"), F.col("total").alias("total"))

    def report(r: Column, lines: Column) -> Column:
        subtotal, tax, total, items = r["subtotal"], r["tax"], r["total"], r["items"]
        logical = F.concat(check_line_math(items), check_total(subtotal, tax, total), subtotal_finding(subtotal, lines))
        return bound(truth_rules_invoice(subtotal, tax, total, items, lines), lambda tests: bound(F.concat(logical, truth_to_findings(tests)), lambda found: counted(found, tests)))

    def counted(found: Column, tests: Column) -> Column:
        return F.struct(tests.alias("truth_tests"), found.alias("findings"), severity_count(found, "error").alias("n_errors"), severity_count(found, "warning").alias("n_warnings"), truth_pass_rate(tests).alias("pass_rate"))

    name = "report"
    while name in records.columns:
        name += "_"
    audited = records.withColumn(name, bound(given, lambda r: bound(line_total_sum(r["items"]), lambda lines: report(r, lines))))
    parts = {c: F.col(f"{name}.{c}") for c in ("truth_tests", "findings", "n_errors", "n_warnings", "pass_rate")}
    score = validation_score(F.col(f"{name}.n_errors"), F.col(f"{name}.n_warnings"), F.col(f"{name}.pass_rate"))
    return audited.withColumns({**parts, "is_valid": F.col(f"{name}.n_errors") == 0, "score": score}).withColumn("grade", confidence_grade(F.col("score"))).drop(name)
