"""Amounts written in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words in natural order, and words of an amount that carry no number.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "million": 1_000_000, "crore": 10_000_000, "crores": 10_000_000, "billion": 1_000_000_000}
FILLERS = ("and", "only", "rs", "inr")
WHOLE, PART = ("rupee", "rupees"), ("paise", "paisa")


def amount_in_words(text: Column) -> Column:
    """The number that a text like "Rupees one lakh twenty-three thousand and fifty paise only" says; null if a word is none of a number's.

    A fold over the words with what is finished, what is being counted, and the last scale: a larger scale multiplies all before it, so
    "two thousand crore" is read as well as "two crore thousand". Null and texts without a number word are null.
    """
    numbers = {**{w: i for i, w in enumerate(UNITS)}, **{w: 10 * (i + 2) for i, w in enumerate(TENS)}}
    table = lambda d: F.create_map(*[F.lit(x) for w, n in d.items() for x in (w, float(n))])
    value, scale = table(numbers), table(SCALES)
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: (w != "") & ~w.isin(*FILLERS))

    def state(done: Column, current: Column, last: Column, cents: Column, n: Column, bad: Column) -> Column:
        return F.struct(done.alias("done"), current.alias("current"), last.alias("last"), cents.alias("cents"), n.alias("n"), bad.alias("bad"))

    def step(s: Column, w: Column) -> Column:
        zero = F.lit(0.0)
        v, k = F.try_element_at(value, w), F.try_element_at(scale, w)
        one = F.when(s["current"] == 0, 1.0).otherwise(s["current"])
        hundreds = state(s["done"], one * 100, s["last"], s["cents"], s["n"] + 1, s["bad"])
        above = state((s["done"] + s["current"]) * k, zero, k, s["cents"], s["n"] + 1, s["bad"])
        below = state(s["done"] + one * k, zero, k, s["cents"], s["n"] + 1, s["bad"])
        return (
            F.when(v.isNotNull(), state(s["done"], s["current"] + v, s["last"], s["cents"], s["n"] + 1, s["bad"]))
            .when(w == "hundred", hundreds)
            .when(k.isNotNull(), F.when((s["last"] > 0) & (s["last"] < k), above).otherwise(below))
            .when(w.isin(*WHOLE), state(s["done"] + s["current"], zero, zero, s["cents"], s["n"], s["bad"]))
            .when(w.isin(*PART), state(s["done"], zero, zero, s["cents"] + s["current"], s["n"], s["bad"]))
            .otherwise(state(s["done"], s["current"], s["last"], s["cents"], s["n"], F.lit(True)))
        )

    start = state(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(False))
    return F.aggregate(words, start, step, lambda s: F.when(~s["bad"] & (s["n"] > 0), s["done"] + s["current"] + s["cents"] / 100))
