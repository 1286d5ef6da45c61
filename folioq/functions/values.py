"""Numbers, dates, phones and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date layouts in the order in which they are tried, day first where it is open.
DATE_FORMATS = ("d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM, yyyy", "d MMM, yyyy")
#: Layouts of the tolerant reader once separators are dashes, and those that give the first of a month.
LOOSE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "M-d-yyyy")
MONTH_FORMATS = ("MMM yyyy", "MMMM yyyy", "yyyy-M", "yyyy")
#: Words for an open end.
OPEN_ENDED = ("present", "current", "ongoing", "till date")
#: Lower bounds of the grades.
GRADES = ((0.95, "A+"), (0.90, "A"), (0.85, "B+"), (0.80, "B"), (0.75, "C+"), (0.70, "C"))


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def to_float(text: Column) -> Column:
    """Number without currency signs, commas and white space; null for anything else."""
    bare = F.regexp_replace(text, r"(?U)[₹$€£¥,\s]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero nor empty text, else the last one as it is."""
    out = values[-1]
    for v in reversed(values[:-1]):
        out = F.when(F.coalesce(~v.cast("string").isin("", "0", "0.0", "-0.0", "false"), F.lit(False)), v).otherwise(out)
    return out


def is_close(a: Column, b: Column, share: float = 0.02) -> Column:
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))


def normalise_phone(raw: Column) -> Column:
    """Digits of any script and plus; ten of them that start with 6 to 9 get +91; without digits the input stays."""
    bare = F.regexp_replace(raw, r"[^\p{Nd}+]", "")
    return F.when(bare.rlike(r"^[6-9][\p{Nd}+]{9}$"), F.concat(F.lit("+91"), bare)).when(bare == "", raw).otherwise(bare)


def laid_out(text: Column) -> Column:
    """The date of a text in the first of DATE_FORMATS that fits. Separators and letters leave one layout to try, so a miss costs one exception at most."""
    read = lambda layout: F.try_to_date(text, layout)
    month_second = text.rlike(r"^\d{1,2}[/-](0?[1-9]|1[0-2])[/-]")
    short = text.rlike(r"(?U)^(\d+ )?\p{L}{1,3}[ ,]")
    named = lambda long, brief: F.when(short, read(brief)).otherwise(read(long))
    return (
        F.when(text.rlike(r"^\d{4,}/"), read("yyyy/M/d"))
        .when(text.contains("/"), F.when(month_second, read("d/M/yyyy")).otherwise(read("M/d/yyyy")))
        .when(text.contains("-"), F.when(month_second, read("d-M-yyyy")).otherwise(read("M-d-yyyy")))
        .when(text.contains("."), read("d.M.yyyy"))
        .when(text.rlike(r"^\p{L}"), named("MMMM d, yyyy", "MMM d, yyyy"))
        .when(text.contains(","), named("d MMMM, yyyy", "d MMM, yyyy"))
        .when(text.contains(" "), named("d MMMM yyyy", "d MMM yyyy"))
    )


def parse_date_iso(text: Column) -> Column:
    """ISO text as it is, else the first layout that fits, as yyyy-MM-dd; null if none does. Outer blanks don't count."""
    read = lambda bare: F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare).otherwise(F.date_format(laid_out(bare), "yyyy-MM-dd"))
    return F.element_at(F.transform(F.array(stripped(text)), read), 1)


def parse_date_flexible(text: Column) -> Column:
    """A date from many layouts, two-digit years (69 to 99 are 19xx), months and years included; null for an open end."""
    once = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)
    century = lambda year: F.when(year >= "69", "-19").otherwise("-20")

    def read(dashed: Column) -> Column:
        short = F.regexp_extract(dashed, r"^(\d{1,2}-\d{1,2})-(\d{2})$", 2)
        long = F.when(short != "", F.concat(F.regexp_extract(dashed, r"^(\d{1,2}-\d{1,2})-", 1), century(short), short)).otherwise(dashed)
        days = once(long, lambda x: F.coalesce(*[F.try_to_date(x, f) for f in LOOSE_FORMATS]))
        return F.coalesce(days, *[F.trunc(F.try_to_date(dashed, f), "month") for f in MONTH_FORMATS])

    return once(F.translate(stripped(text), "/.", "--"), lambda dashed: F.when(~F.lower(dashed).isin(*OPEN_ENDED), read(dashed)))


def confidence_grade(score: Column) -> Column:
    out = F.lit("D")
    for bound, grade in reversed(GRADES):
        out = F.when(score >= bound, grade).otherwise(out)
    return out


def grade_badge(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def percent_text(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", share.cast("double") * 100)
