"""One audit for records of any type, kept as VARIANT: arithmetic, a model's findings, changes of form, truth tests and the score.

Fields are read under their alternate names and amounts as numbers or texts, as they come. Everything is an expression over the record, so a
table is audited without a shuffle; what depends on the type is one CASE of which a row evaluates its own branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.json import issue_ingest
from folioq.functions.values import confidence_grade, is_close
from folioq.functions.variants import amount, at, bound, elements, pick, shape, text_of, truthy, walk
from folioq.operators.normalise import CHANGE, RULES
from folioq.operators.truth import line_items, truth_rules
from folioq.operators.validation import FINDING, TEST, amount_text, finding, none, severity_count, truth_pass_rate, truth_to_findings, validation_score, when_true


def check_line_math(record: Column) -> Column:
    """An error for every item whose quantity times price is not its total within 2 %; items that are no objects are skipped."""

    def check(x: Column, i: Column) -> Column:
        field = F.concat(F.lit("line_items."), i.cast("string"), F.lit(".total"))
        expected = F.round(x["quantity"] * x["price"], 2)
        return F.when(~is_close(expected, x["total"]), finding("error", field, "Quantity × Unit Price ≠ Total", amount_text(expected), amount_text(x["total"])))

    return bound(line_items(record), lambda items: F.coalesce(F.array_compact(F.transform(items, check)), none(FINDING)))


def check_totals(record: Column) -> Column:
    """An error if subtotal and tax miss the total, a warning if the items' sum is positive and misses the subtotal."""
    read = F.struct(
        amount(at(record, "subtotal")).alias("subtotal"),
        amount(pick(record, "tax", "tax_amount")).alias("tax"),
        amount(pick(record, "total", "grand_total")).alias("total"),
        F.aggregate(line_items(record), F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0))).alias("lines"),
    )

    def check(r: Column) -> Column:
        expected = F.round(r["subtotal"] + r["tax"], 2)
        whole = when_true(~is_close(expected, r["total"]), finding("error", F.lit("total"), "Subtotal + Tax ≠ Total", amount_text(expected), amount_text(r["total"])))
        parts = when_true((r["lines"] > 0) & ~is_close(r["subtotal"], r["lines"]), finding("warning", F.lit("subtotal"), "Subtotal ≠ sum of line-item totals", amount_text(r["lines"]), amount_text(r["subtotal"])))
        return F.concat(whole, parts)

    return bound(read, check)


def check_grad_year(record: Column, as_of_year: Column) -> Column:
    """A warning for every graduation year before 1950 or more than ten years ahead; the end of studies stands in for a missing graduation."""

    def check(x: Column, i: Column) -> Column:
        said = pick(x, "graduation_date", "end_date")
        year = F.when(truthy(said), F.nullif(F.regexp_extract(text_of(said), r"(\d{4})", 1), F.lit("")).cast("int"))
        return F.when((year > as_of_year + 10) | (year < 1950), finding("warning", F.concat(F.lit("education."), i.cast("string"), F.lit(".graduation_date")), "Graduation year looks unrealistic", None, year.cast("string")))

    return F.coalesce(F.array_compact(F.transform(elements(at(record, "education")), check)), none(FINDING))


def changes(record: Column) -> Column:
    """What normalisation would change in a record of any shape: dates, phones and amounts by the tokens of their keys, at any depth."""

    def of(e: Column) -> Column:
        def step(tokens: tuple[str, ...], rule: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
            return lambda s: stepped(s, tokens, rule, name)

        def stepped(s: Column, tokens: tuple[str, ...], rule: Callable[[Column], Column], name: str) -> Column:
            new = F.when(F.lower(e["key"]).rlike("|".join(tokens)), rule(s["text"])).otherwise(s["text"])
            entry = lambda n: F.array(F.struct(e["path"].alias("field"), s["text"].alias("original_value"), n.alias("normalised_value"), F.lit(name).alias("rule_applied")))
            return bound(new, lambda n: F.struct(n.alias("text"), F.concat(s["log"], F.when(n != s["text"], entry(n)).otherwise(F.array().cast(CHANGE))).alias("log")))

        out = F.struct(text_of(e["value"]).alias("text"), F.array().cast(CHANGE).alias("log"))
        for tokens, rule, name in RULES:
            out = bound(out, step(tokens, rule, name))
        return out["log"]

    every = "|".join(t for tokens, _, _ in RULES for t in tokens)
    wanted = F.filter(walk(record, lists=True), lambda e: F.lower(e["key"]).rlike(every) & (shape(e["value"]) == "STRING"))
    return F.coalesce(F.flatten(F.transform(wanted, of)), F.array().cast(CHANGE))


def audit(records: DataFrame, as_of: Column, kind: str = "document_type", record: str = "record", replies: str | None = None) -> DataFrame:
    """records with findings, changes, truth_tests, n_errors, n_warnings, pass_rate, is_valid, score and grade.

    as_of is the day of the audit. replies names a column with a model's findings as text. A null record, or one that is no object, has nothing to find; records of
    types without rules have no truth tests. Columns of these names are replaced, all others stay.
    """
    v, k = F.col(f"`{record}`"), F.lower(F.col(f"`{kind}`"))
    logical = F.concat(check_line_math(v), check_totals(v), F.when(k == "resume", check_grad_year(v, F.year(as_of))).otherwise(none(FINDING)))
    said = F.coalesce(issue_ingest(F.col(f"`{replies}`")), none(FINDING)) if replies else none(FINDING)
    there = F.coalesce(shape(v) == "OBJECT", F.lit(False))

    def report(tests: Column) -> Column:
        found = F.concat(F.when(there, logical).otherwise(none(FINDING)), said, truth_to_findings(tests))
        return bound(found, lambda f: F.struct(f.alias("findings"), tests.alias("truth_tests"), severity_count(f, "error").alias("n_errors"), severity_count(f, "warning").alias("n_warnings"), truth_pass_rate(tests).alias("pass_rate")))

    tests = F.when(there, truth_rules(k, v, as_of)).otherwise(none(TEST))
    name = "report"
    while name in records.columns:
        name += "_"
    audited = records.withColumn(name, bound(tests, report)).withColumn("changes", changes(v))
    parts = {c: F.col(f"{name}.{c}") for c in ("findings", "truth_tests", "n_errors", "n_warnings", "pass_rate")}
    score = validation_score(F.col(f"{name}.n_errors"), F.col(f"{name}.n_warnings"), F.col(f"{name}.pass_rate"))
    return audited.withColumns({**parts, "is_valid": F.col(f"{name}.n_errors") == 0, "score": score}).withColumn("grade", confidence_grade(F.col("score"))).drop(name)
