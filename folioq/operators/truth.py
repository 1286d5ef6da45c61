"""Truth tests by document type over VARIANT records: rules that hold for every true document.

A rule whose fields are missing or unreadable is left out, except those that ask for a field to be there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioq.functions.values import is_close, parse_date_flexible
from folioq.functions.variants import amount, at, elements, filled as says, pick, shape, walk
from folioq.functions.words import amount_in_words
from folioq.operators.scoring import has_content, text_at
from folioq.operators.validation import TEST, amount_text, none, truth_test

Rules = Callable[[Column, Column], list[Column]]


def number(v: Column, path: str) -> Column:
    return amount(at(v, path))


def day(v: Column, path: str) -> Column:
    return parse_date_flexible(text_at(v, path))


def there(v: Column, path: str) -> Column:
    return truth_test(f"{path}_present", f"{path} is present", has_content(v, path))


def past(v: Column, path: str, as_of: Column) -> Column:
    return truth_test(f"{path}_in_past", f"{path} is not in the future", day(v, path) <= as_of)


def ordered(v: Column, first: str, then: str) -> Column:
    return truth_test(f"{then}_after_{first}", f"{then} is after {first}", day(v, first) < day(v, then))


def shaped(v: Column, path: str, pattern: str, says: str) -> Column:
    return truth_test(f"{path}_format", f"{path} {says}", F.regexp_replace(text_at(v, path), r"[\s-]", "").rlike(pattern))


def filled(v: Column, path: str) -> Column:
    listed = F.try_variant_get(v, "$." + path, "array<variant>")
    return truth_test(f"{path}_not_empty", f"{path} is not empty", F.size(listed) > 0)


def same(name: str, says: str, a: Column, b: Column, within: float = 0.01) -> Column:
    return truth_test(name, says, F.abs(a - b) <= within)


def summed(v: Column, path: str, field: str) -> Column:
    return F.aggregate(elements(at(v, path)), F.lit(0.0), lambda a, x: a + F.coalesce(amount(at(x, field)), F.lit(0.0)))


def line_items(v: Column) -> Column:
    """(quantity, price, total) of the items of a record, under the names that they go by; null for an item that is no object."""
    item = lambda x: F.struct(amount(at(x, "quantity")).alias("quantity"), amount(pick(x, "unit_price", "rate", "price")).alias("price"), amount(pick(x, "total", "amount")).alias("total"))
    return F.transform(elements(pick(v, "line_items", "items")), lambda x: F.when(shape(x) == "OBJECT", item(x)))


def invoice(v: Column) -> list[Column]:
    items = line_items(v)  # read again by each test, of which an invoice has three
    known = F.filter(items, lambda x: (x["quantity"] * x["price"] * x["total"]).isNotNull())
    lines = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0)))
    subtotal, whole = number(v, "subtotal"), number(v, "subtotal") + amount(pick(v, "tax", "tax_amount"))
    total = amount(pick(v, "total", "grand_total"))
    return [
        truth_test("line_math", "quantity * unit_price = total", F.when(F.size(known) > 0, F.forall(known, lambda x: is_close(F.round(x["quantity"] * x["price"], 2), x["total"])))),
        truth_test("subtotal", "sum of line totals = subtotal", F.when(F.size(items) > 0, is_close(lines, subtotal)), amount_text(lines), amount_text(subtotal)),
        truth_test("total", "subtotal + tax = total", is_close(whole, total), amount_text(whole), amount_text(total)),
    ]


def statement(v: Column) -> list[Column]:
    read = lambda x, field: amount(at(x, field))
    moved = lambda x: F.coalesce(read(x, "credit"), F.lit(0.0)) - F.coalesce(read(x, "debit"), F.lit(0.0))
    rows = F.transform(elements(at(v, "transactions")), lambda x: F.struct(moved(x).alias("moved"), read(x, "balance").alias("balance")))
    opening, closing = number(v, "opening_balance"), number(v, "closing_balance")
    reached = opening + F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["moved"])
    before = F.concat(F.array(opening), F.transform(rows, lambda x: x["balance"]))
    steps = F.transform(rows, lambda x, i: F.coalesce(F.abs(F.get(before, i) + x["moved"] - x["balance"]) <= 0.01, F.lit(True)))
    return [
        truth_test("closing", "opening + credits - debits = closing", F.abs(reached - closing) <= 0.01, amount_text(reached), amount_text(closing)),
        truth_test("running_balance", "each balance follows from the one before", F.when(F.size(rows) > 0, F.forall(steps, lambda s: s))),
    ]


def resume(v: Column, as_of: Column) -> list[Column]:
    jobs, studies = elements(at(v, "experience")), elements(at(v, "education"))
    wrong = F.exists(jobs, lambda j: F.coalesce(day(j, "start_date") > day(j, "end_date"), F.lit(False)))
    years = F.array_compact(F.transform(studies, lambda x: F.nullif(F.regexp_extract(text_at(x, "graduation_date"), r"(\d{4})", 1), F.lit("")).cast("int")))
    return [
        truth_test("jobs_in_order", "no job ends before it starts", F.when(F.size(jobs) > 0, ~wrong)),
        truth_test("graduation_realistic", "graduations lie between 1950 and five years ahead", F.when(F.size(years) > 0, F.forall(years, lambda y: y.between(1950, F.year(as_of) + 5)))),
    ]


def dosages(v: Column) -> Column:
    found = F.array_compact(F.transform(elements(at(v, "medicines")), lambda x: F.nullif(F.regexp_extract(text_at(x, "dosage"), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")))
    return truth_test("dosage_positive", "dosages are positive", F.when(F.size(found) > 0, F.forall(found, lambda d: d > 0)))


def said_anywhere(v: Column, path: str) -> Column:
    """Whether an object holds anything at all."""
    return truth_test(f"{path}_present", f"{path} is present", F.exists(walk(at(v, path)), lambda e: says(e["value"])))


def words_and_figures(v: Column) -> Column:
    words, figures = amount_in_words(text_at(v, "amount_words")), number(v, "amount_figures")
    return truth_test("amount_in_words", "amount in words = amount in figures", F.abs(words - figures) < 0.005, amount_text(words), amount_text(figures))


#: Rules by type; as_of is the day of the audit.
RULES: dict[str, Rules] = {
    "marksheet": lambda v, as_of: [
        same("marks", "sum of marks = total marks", summed(v, "subjects", "marks_obtained"), number(v, "total_marks")),
        same("max_marks", "sum of maximum marks = maximum total", summed(v, "subjects", "max_marks"), number(v, "max_total_marks")),
        same("percentage", "total / maximum = percentage", F.try_divide(number(v, "total_marks"), number(v, "max_total_marks")) * 100, number(v, "percentage"), 0.5),
    ],
    "contract": lambda v, as_of: [ordered(v, "effective_date", "expiration_date"), truth_test("value_positive", "payment amount is positive", number(v, "payment_terms.amount") > 0), filled(v, "parties")],
    "prescription": lambda v, as_of: [past(v, "date", as_of), filled(v, "medicines"), dosages(v)],
    "utility_bill": lambda v, as_of: [same("units", "current - previous reading = units", number(v, "current_reading") - number(v, "previous_reading"), number(v, "units_consumed"))],
    "aadhar_card": lambda v, as_of: [shaped(v, "uid_number", "^[0-9]{12}$", "has 12 digits"), past(v, "dob", as_of), there(v, "name"), said_anywhere(v, "address")],
    "pan_card": lambda v, as_of: [shaped(v, "pan_number", "^[A-Z]{5}[0-9]{4}[A-Z]$", "is five letters, four digits, a letter"), past(v, "dob", as_of)],
    "passport": lambda v, as_of: [ordered(v, "issue_date", "expiry_date"), past(v, "dob", as_of), there(v, "passport_number")],
    "land_record": lambda v, as_of: [truth_test("area_positive", "area is positive", number(v, "total_area.value") > 0), filled(v, "owners")],
    "certificate": lambda v, as_of: [past(v, "issue_date", as_of), there(v, "primary_person.name")],
    "gst_certificate": lambda v, as_of: [shaped(v, "gstin", "^.{15}$", "has 15 characters"), truth_test("gstin_state_code", "gstin starts with a state code", text_at(v, "gstin").rlike(r"^\s*(0[1-9]|[1-3][0-9])"))],
    "invoice": lambda v, as_of: invoice(v),
    "bank_statement": lambda v, as_of: statement(v),
    "resume": resume,
    "ration_card": lambda v, as_of: [there(v, "card_number"), filled(v, "family_members")],
    "cheque": lambda v, as_of: [words_and_figures(v), truth_test("date_recent", "date is at most three months old", F.add_months(day(v, "date"), 3) >= as_of)],
}


def truth_rules(kind: Column, record: Column, as_of: Column) -> Column:
    """The tests of a record of a type; none for types without rules."""
    low = F.lower(kind)
    tests = {t: F.array_compact(F.array(*rules(record, as_of))).cast(f"array<{TEST}>") for t, rules in RULES.items()}
    return reduce(lambda out, t: F.when(low == t, tests[t]).otherwise(out), tests, none(TEST))
