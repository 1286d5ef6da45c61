"""Values that follow from others: totals, durations, parts of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holder types by the fourth character of a PAN, and states by the first two digits of a GSTIN.
PAN_TYPES = {"P": "Individual", "C": "Company", "H": "Hindu Undivided Family", "F": "Firm", "A": "Association of Persons", "T": "Trust", "B": "Body of Individuals", "L": "Local Authority", "J": "Artificial Juridical Person", "G": "Government"}
GST_STATES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar",
    "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand",
    "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "25": "Daman and Diu", "26": "Dadra and Nagar Haveli", "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa",
    "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory",
}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def derive_invoice_total(total: Column, subtotal: Column, tax: Column) -> Column:
    """The stated total, else subtotal and tax."""
    return F.coalesce(total, subtotal + tax)


def derive_currency(currency: Column) -> Column:
    return F.coalesce(currency, F.lit("USD"))


def derive_duration(start: Column, end: Column, as_of: Column) -> Column:
    """Whole years and months from start to end, or to as_of where the end is open."""
    months = F.floor(F.months_between(F.trunc(F.coalesce(end, as_of), "month"), F.trunc(start, "month"))).cast("int")
    return F.when(months >= 0, F.format_string("%d years %d months", F.floor(months / 12).cast("int"), months % 12))


def derive_units(units: Column, previous: Column, current: Column) -> Column:
    return F.coalesce(units, current - previous)


def derive_percentage(total: Column, most: Column) -> Column:
    """Null where the maximum is zero."""
    return F.round(F.try_divide(total, most) * 100, 2)


def derive_pan_type(pan: Column) -> Column:
    return looked_up(F.upper(F.substring(pan, 4, 1)), PAN_TYPES)


def derive_gst_state(gstin: Column) -> Column:
    return looked_up(F.substring(gstin, 1, 2), GST_STATES)


def derive_assessment_year(day: Column) -> Column:
    """(assessment_year, quarter) of a day; years begin in April, and the first quarter is April to June."""
    shifted = F.add_months(day, -3)
    year = F.year(shifted)
    return F.struct(F.concat_ws("-", (year + 1).cast("string"), F.lpad(((year + 2) % 100).cast("string"), 2, "0")).alias("assessment_year"), F.concat(F.lit("Q"), F.quarter(shifted).cast("string")).alias("quarter"))


def derive_nrega_totals(entries: Column) -> Column:
    """(total_days_worked, total_wages_earned) over work entries (days_worked, amount_earned)."""
    add = lambda name: F.aggregate(entries, F.lit(0.0), lambda a, x: a + F.coalesce(x[name].cast("double"), F.lit(0.0)))
    return F.struct(add("days_worked").alias("total_days_worked"), add("amount_earned").alias("total_wages_earned"))


def split_job_card(number: Column) -> Column:
    """(state, district, block, panchayat, household); null parts for a number with other than five."""
    parts = F.split(number, "/")
    return F.struct(*[F.when(F.size(parts) == 5, F.get(parts, i)).alias(n) for i, n in enumerate(("state", "district", "block", "panchayat", "household"))])


def split_mrz(line1: Column, line2: Column) -> Column:
    """Fields of the two lines of 44 characters of a passport; null for other lengths."""
    ok = (F.length(line1) == 44) & (F.length(line2) == 44)
    names = F.split(F.substring(line1, 6, 39), "<<")
    clean = lambda x: F.btrim(F.translate(x, "<", " "))
    part = lambda x, a, n: F.when(ok, clean(F.substring(x, a, n)))
    return F.struct(
        part(line1, 3, 3).alias("issuer"), F.when(ok, clean(F.get(names, 0))).alias("surname"), F.when(ok, clean(F.get(names, 1))).alias("given_names"), part(line2, 1, 9).alias("number"), part(line2, 11, 3).alias("nationality"), part(line2, 14, 6).alias("dob"), part(line2, 21, 1).alias("sex"), part(line2, 22, 6).alias("expiry")
    )
