"""Profiles of extracted text; every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioq.functions.values import stripped
from folioq.functions.variants import bound

#: Scripts told apart, by language code.
SCRIPTS = {"hin": r"[\x{0900}-\x{097F}]", "guj": r"[\x{0A80}-\x{0AFF}]", "eng": r"[\x{0041}-\x{007A}]"}
LANGUAGE_NAMES = {"eng": "English", "hin": "Hindi", "guj": "Gujarati"}


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def detect_script(text: Column) -> Column:
    """hin or guj from 15 % of the letters counted (hin first), else eng.

    A script's letters are what is left of the text without all others, so no letter becomes a text of its own; one range a
    pattern, as ranges of several scripts in one are read eight times slower.
    """
    counts = lambda t: F.struct(*[F.length(F.regexp_replace(t, f"[^{p[1:-1]}]+", "")).alias(code) for code, p in SCRIPTS.items()])

    def told(n: Column) -> Column:
        total = n["hin"] + n["guj"] + n["eng"]
        share = {code: F.when(total > 0, n[code] / total).otherwise(0.0) for code in ("hin", "guj")}
        return F.when((share["hin"] >= 0.15) & (share["hin"] >= share["guj"]), "hin").when(share["guj"] >= 0.15, "guj").otherwise("eng")

    return bound(F.coalesce(text, F.lit("")), lambda t: bound(counts(t), told))


def garbage_text(text: Column) -> Column:
    """Text that is short, has few words or many symbols; null counts as garbage.

    Words are counted as they start and real ones as they first show three letters in a row, so no array of words is built.
    """
    tokens = F.regexp_count(text, F.lit(r"(?U)\S+"))
    real = F.regexp_count(text, F.lit(r"(?U)[a-zA-Z\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]{3}\S*"))
    shown = F.length(F.translate(text, "\n ", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    symbols = F.when(shown > 0, 1 - letters / shown).otherwise(1.0)
    short = F.length(stripped(text)) < 20
    return F.coalesce(F.when(short | (tokens == 0), True).otherwise((real / tokens < 0.40) | (symbols > 0.35)), F.lit(True))


def chunk_text(text: Column, limit: int = 8000, size: int = 4000, overlap: int = 500) -> Column:
    """Array of windows of a text longer than limit, else the whole text; a window that reaches the end is the last."""
    starts = F.sequence(F.lit(0), F.ceil((F.length(text) - size) / (size - overlap)).cast("int"))
    return F.when(F.length(text) > limit, F.transform(starts, lambda k: F.substring(text, k * (size - overlap) + 1, F.lit(size)))).otherwise(F.array(text))


def truncate_json(text: Column, n: int, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def clean_filename(name: Column, ts: Column | None = None) -> Column:
    """Base name with unusual characters as _ and without outer dots and underscores; nothing left gives upload_ts."""
    bare = F.btrim(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_"), F.lit("._"))
    return bare if ts is None else F.when(F.coalesce(bare, F.lit("")) == "", F.concat(F.lit("upload_"), ts.cast("string"))).otherwise(bare)


def language_name(code: Column) -> Column:
    """The name of a language code; other codes stay."""

    def named(c: Column) -> Column:
        out = c
        for k, v in LANGUAGE_NAMES.items():
            out = F.when(c == k, v).otherwise(out)
        return out

    return bound(code, named)


#: Page markers, with what an OCR marker tells.
PAGE_MARK = r"\n?--- Page \d+[^\n]*---\n?"
PAGE_HEAD = r"--- Page (\d+)(?: \(Language: ([^,]*), OCR Confidence: ([0-9.]+)%, Engine: ([^)]*)\))? ---"
#: Formats of identifiers and common values. What may not stand beside a value is looked at, not taken, so that values may follow each other closely.
IDENTIFIERS = {
    "gstin": r"(?<![A-Z0-9])[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z](?![A-Z0-9])",
    "pan": r"(?<![A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Z0-9])",
    "uid": r"(?<![0-9-])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9-])",
    "ifsc": r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])",
    "passport": r"(?<![A-Z0-9])[A-PR-WY][0-9]{7}(?![0-9])",
    "dl": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[ -]?[0-9]{11}(?![0-9])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]",
    "phone": r"[+][0-9]{1,3}(?: ?[(]?[0-9]{3}[)]? ?[0-9]{3}-[0-9]{4}|[ -]?[6-9][0-9]{4}[ -]?[0-9]{5})(?![0-9])",
    "amount": r"[₹$€£] ?[0-9][0-9,]*(?:[.][0-9]+)?",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:/[0-9]{1,2}/|-[0-9]{1,2}-|[.][0-9]{1,2}[.])[0-9]{4})(?![0-9])",
}


def clean_script(text: Column, code: Column) -> Column:
    """Without single stray letters of the other Indian script and with spaces and blank lines squeezed; English stays."""
    lone = r"(?U)(?<!\S)[\x{%s}-\x{%s}](?!\S)"
    hin = F.regexp_replace(text, lone % ("0A80", "0AFF"), "")
    guj = F.regexp_replace(text, lone % ("0900", "097F"), "")
    bare = F.when(code == "hin", hin).when(code == "guj", guj).otherwise(text)
    return F.when(code == "eng", text).otherwise(F.regexp_replace(F.regexp_replace(bare, "  +", " "), r"\n{3,}", "\n\n"))


def split_pages(text: Column) -> Column:
    """Array of (page, language, confidence, engine, text) of a text with page markers; without markers it is page 1."""
    marks = F.regexp_extract_all(text, F.lit(PAGE_HEAD), F.lit(0))
    parts = F.split(text, PAGE_MARK, -1)
    text_or_null = lambda m, i: F.nullif(F.regexp_extract(m, PAGE_HEAD, i), F.lit(""))
    one = F.array(F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("engine"), text.alias("text")))
    many = F.transform(marks, lambda m, i: F.struct(text_or_null(m, 1).cast("int").alias("page"), text_or_null(m, 2).alias("language"), text_or_null(m, 3).cast("double").alias("confidence"), text_or_null(m, 4).alias("engine"), F.get(parts, i + 1).alias("text")))
    return F.when(F.size(marks) > 0, many).otherwise(one)


def page_first_marker(text: Column) -> Column:
    """The share in the first OCR confidence marker, within 0 and 1; null without one."""
    found = F.regexp_extract(text, r"OCR Confidence: ([0-9]+(?:\.[0-9]+)?)%", 1)
    return F.when(found != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), found.cast("double") / 100)))


def layout_profile(text: Column) -> Column:
    """(text_regions, has_tables, has_images): lines, and whether tables or images are marked."""
    return F.struct(F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("text_regions"), F.coalesce(F.contains(text, F.lit("|")), F.lit(False)).alias("has_tables"), F.coalesce(text.rlike("(?i)<img|\\[image"), F.lit(False)).alias("has_images"))


def parse_pipe_table(text: Column) -> Column:
    """Rows of cells of all marked tables in turn, else of all lines with pipes; cells are trimmed, outer pipes dropped."""
    marked = F.regexp_extract_all(text, F.lit(r"(?s)\[TABLE\](.*?)\[/TABLE\]"), F.lit(1))
    lines = F.filter(F.split(F.when(F.size(marked) > 0, F.array_join(marked, "\n")).otherwise(text), "\n"), lambda x: F.contains(x, F.lit("|")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))


def run_folder_name(name: Column, ts: Column) -> Column:
    """yyyyMMdd_HHmmss and the file name's stem with anything but letters and digits as _."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"))


def title_label(key: Column, prefix: Column | None = None) -> Column:
    """A key in title case, after its parent's label if there is one."""
    label = F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
    return label if prefix is None else F.concat_ws(" > ", prefix, label)


def extract_identifiers(text: Column) -> Column:
    """Array of (kind, value) of all identifiers in the text, by kind in the order of IDENTIFIERS, then by place."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    of = [found(k, p) for k, p in IDENTIFIERS.items()]
    return F.coalesce(F.concat(*of), F.array().cast("array<struct<kind: string, value: string>>"))


def detect_language_set(available: Column, detected: Column | None = None) -> Column:
    """Language packs to read with: eng with all available ones, or with the detected one only."""
    packs = F.array(F.lit("hin"), F.lit("guj"))
    wanted = packs if detected is None else F.array_intersect(packs, F.array(detected))
    return F.array_join(F.concat(F.array(F.lit("eng")), F.array_intersect(wanted, available)), "+")
