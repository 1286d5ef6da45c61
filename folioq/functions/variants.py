"""Reading records as they are: VARIANT values of any shape, whatever a registry says of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioq.functions.values import to_float

ENTRY = "array<struct<path: string, key: string, value: variant>>"
#: Levels of lists that are set aside when the depth of objects is estimated; more of them only make the estimate larger.
NESTED_LISTS = 3


def at(record: Column, path: str) -> Column:
    """The value at a dot path as a variant; null only if a key is missing."""
    return F.try_variant_get(record, "$." + path, "variant")


def text_of(value: Column) -> Column:
    """A value as text, lists and objects as JSON; null for null."""
    return F.try_variant_get(value, "$", "string")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value written and evaluated once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def shape(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, BOOLEAN or the name of a number's type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def truthy(value: Column) -> Column:
    """Neither missing, null, false, zero, an empty text, nor an empty list or object."""
    number = F.try_variant_get(value, "$", "double")
    kind, text = shape(value), text_of(value)
    return F.coalesce(F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind.isin("ARRAY", "OBJECT"), ~text.isin("[]", "{}")).otherwise(number != 0), F.lit(False))


def pick(value: Column, *paths: str) -> Column:
    """The first truthy one of the values at the paths, else the last as it is."""
    out = at(value, paths[-1])
    for path in reversed(paths[:-1]):
        out = first_of(at(value, path), out)
    return out


def first_of(own: Column, other: Column) -> Column:
    return bound(own, lambda x: F.when(truthy(x), x).otherwise(other))


def amount(value: Column) -> Column:
    """A number, or a text that is one once signs of currency, commas and blanks are gone."""
    return bound(value, lambda x: F.when(shape(x) == "STRING", to_float(text_of(x))).otherwise(F.try_variant_get(x, "$", "double")))


def elements(value: Column) -> Column:
    """The elements of a list; none for anything else."""
    return bound(value, lambda x: F.coalesce(F.when(shape(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")), F.array().cast("array<variant>")))


def depth_bound(record: Column, lists: bool) -> Column:
    """A number of steps in which every object (and list) of a record is surely opened: its brackets outside texts."""
    bare = F.regexp_replace(F.to_json(record), r'"(?:[^"\\]++|\\.)*+"', "")
    if lists:
        return F.regexp_count(bare, F.lit(r"[\[{]"))
    for _ in range(NESTED_LISTS):
        bare = F.regexp_replace(bare, r"\[[^\[\]]*\]", "")
    return F.regexp_count(bare, F.lit(r"\{"))


def walk(record: Column, lists: bool = False) -> Column:
    """Array of (path, key, value) of every leaf of a record: what is in objects of any depth, keys in their order in the variant.

    A list is one leaf, or, with `lists`, is opened too, its items having their number in the path and no key. Empty objects have no leaf, a null
    record has none, and a record that is no object is one leaf without a path. No schema is asked.
    """

    def opened(e: Column) -> Column:
        kind = shape(e["value"])
        inside = lambda key: F.when(e["path"] == "", key).otherwise(F.concat(e["path"], F.lit("."), key))
        entries = F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
        fields = F.transform(entries, lambda x: F.struct(inside(x["key"]).alias("path"), x["key"].alias("key"), x["value"].alias("value")))
        out = F.when(kind == "OBJECT", fields)
        if lists:
            items = F.try_variant_get(e["value"], "$", "array<variant>")
            out = out.when(kind == "ARRAY", F.transform(items, lambda x, i: F.struct(inside(i.cast("string")).alias("path"), F.lit("").alias("key"), x.alias("value"))))
        return out.otherwise(F.array(F.struct(e["path"].alias("path"), e["key"].alias("key"), e["value"].alias("value"))))

    start = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("key"), record.alias("value"))).cast(ENTRY)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), depth_bound(record, lists)))
    found = F.aggregate(steps, start, lambda acc, i: F.flatten(F.transform(acc, opened)).cast(ENTRY))
    return F.when(record.isNotNull(), found).otherwise(F.array().cast(ENTRY))


def filled(value: Column) -> Column:
    """Whether a leaf says something: a list with items, a text that isn't blank, any number or truth value."""
    kind = shape(value)
    return F.coalesce(F.when(kind == "ARRAY", text_of(value) != "[]").otherwise(text_of(value).rlike(r"(?U)\S")), F.lit(False))
