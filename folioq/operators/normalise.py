"""Dates, phones and amounts of a typed record brought to one form, with a log of every change.

The rewrite is compiled from the record's type: a text whose key holds one of the tokens gets the expressions of its kinds, date
first, then phone, then amount. Objects and lists are followed; a change in a list has the item's number in its path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from folioq.functions.values import normalise_phone, parse_date_iso, to_float
from folioq.functions.variants import bound

#: Tokens of keys, looked for anywhere in the key, and the names of the rules.
DATE_TOKENS = ("date", "dob", "birth", "expiry", "issued", "due")
PHONE_TOKENS = ("phone", "mobile", "contact", "tel")
AMOUNT_TOKENS = ("amount", "total", "subtotal", "tax", "price", "cost", "fee", "premium")
DATE_RULE, PHONE_RULE, AMOUNT_RULE = "ISO 8601 date conversion", "Phone number normalisation", "Currency string to float"
CHANGE = "array<struct<field: string, original_value: string, normalised_value: string, rule_applied: string>>"


def new_date(x: Column) -> Column:
    return F.when(~x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.coalesce(parse_date_iso(x), x)).otherwise(x)


def new_phone(x: Column) -> Column:
    return F.when(F.btrim(x) != "", normalise_phone(x)).otherwise(x)


def new_amount(x: Column) -> Column:
    return F.when(x.rlike(r"(?U)[₹$€£¥,\s]"), F.coalesce(to_float(x).cast("string"), x)).otherwise(x)


RULES = ((DATE_TOKENS, new_date, DATE_RULE), (PHONE_TOKENS, new_phone, PHONE_RULE), (AMOUNT_TOKENS, new_amount, AMOUNT_RULE))


def rules_of(key: str) -> list[tuple[Callable[[Column], Column], str]]:
    return [(rule, name) for tokens, rule, name in RULES if any(t in key.lower() for t in tokens)]


def rewritten(kind: DataType, value: Column, key: str) -> Column:
    """The value in its new form."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[rewritten(f.dataType, value[f.name], f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rewritten(kind.elementType, x, ""))
    for rule, _ in rules_of(key) if isinstance(kind, StringType) else []:
        value = rule(value)
    return value


def differences(kind: DataType, old: Column, new: Column, path: Column | None, key: str) -> list[Column]:
    """The arrays of changes that lead from a value to its new form, children first. Where several rules meet in one key, its steps are made again."""
    if isinstance(kind, StructType):
        at = lambda f: F.concat(path, F.lit("." + f)) if path is not None else F.lit(f)
        return [c for f in kind.fields for c in differences(f.dataType, old[f.name], new[f.name], at(f.name), f.name)]
    if isinstance(kind, ArrayType):
        inside = lambda x, i: joined(differences(kind.elementType, x, F.get(new, i), F.concat(path, F.lit("."), i.cast("string")), ""))
        return [F.coalesce(F.flatten(F.transform(old, inside)), F.array().cast(CHANGE))] if holds_rules(kind.elementType) else []
    found, rules = [], rules_of(key) if isinstance(kind, StringType) else []
    for n, (rule, name) in enumerate(rules):
        then = new if n == len(rules) - 1 else rule(old)
        entry = F.struct(path.alias("field"), old.alias("original_value"), then.alias("normalised_value"), F.lit(name).alias("rule_applied"))
        found.append(F.when(F.coalesce(then != old, F.lit(False)), F.array(entry)).otherwise(F.array().cast(CHANGE)))
        old = then
    return found


def holds_rules(kind: DataType, key: str = "") -> bool:
    """Whether anything in a value of this type can change."""
    if isinstance(kind, StructType):
        return any(holds_rules(f.dataType, f.name) for f in kind.fields)
    return holds_rules(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, StringType) and bool(rules_of(key))


def joined(changes: list[Column]) -> Column:
    return F.concat(*changes) if changes else F.array().cast(CHANGE)


def normalise(df: DataFrame, record: str, changes: str = "changes") -> DataFrame:
    """df with the record in its new form and the array of its changes. A null record stays null and has none."""
    kind, name = df.schema[record].dataType, "normalised"
    while name in df.columns:
        name += "_"

    def both(old: Column) -> Column:
        return bound(rewritten(kind, old, ""), lambda new: F.struct(new.alias("record"), joined(differences(kind, old, new, None, "")).alias("changes")))

    return df.withColumn(name, bound(F.col(record), both)).withColumns({record: F.col(f"{name}.record"), changes: F.col(f"{name}.changes")}).drop(name)
