"""Checks of incoming files, from their names, sizes, first bytes and what a reader tells of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import garbage_text

#: Suffixes by kind, accepted suffixes, the largest file, and first bytes by suffix.
SUFFIXES = {"pdf": (".pdf",), "docx": (".docx", ".doc"), "image": (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp")}
ALLOWED = (".pdf", ".docx", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")
MAX_BYTES = 200 * 1024 * 1024
MAGIC = {".pdf": ("255044462D",), ".docx": ("504B",), ".png": ("89504E470D0A1A0A",), ".jpg": ("FFD8FF",), ".jpeg": ("FFD8FF",), ".tiff": ("49492A00", "4D4D002A"), ".bmp": ("424D",)}
IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".bmp")


def scan_binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of all files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def file_type(name: Column) -> Column:
    """pdf, docx, image or unknown."""
    return reduce(lambda out, kind: F.when(suffix(name).isin(*SUFFIXES[kind]), kind).otherwise(out), SUFFIXES, F.lit("unknown"))


def allowed_extension(name: Column) -> Column:
    return F.coalesce(suffix(name).isin(*ALLOWED), F.lit(False))


def size_limit(length: Column, most: int = MAX_BYTES) -> Column:
    return F.coalesce(length <= most, F.lit(False))


def magic_bytes(name: Column, content: Column) -> Column:
    """ok, warning (an image of another kind than its suffix says), or error."""
    head, ext = F.hex(F.substring(content, 1, 8)), suffix(name)
    starts = lambda e: reduce(lambda a, b: a | b, [head.startswith(m) for m in MAGIC[e]])
    fits = reduce(lambda out, e: F.when(ext == e, starts(e)).otherwise(out), MAGIC, F.lit(False))
    image = reduce(lambda a, b: a | b, [starts(e) for e in IMAGES])
    return F.when(F.coalesce(fits, F.lit(False)), "ok").when(ext.isin(*IMAGES) & F.coalesce(image, F.lit(False)), "warning").otherwise("error")


def image_quality(width: Column, height: Column) -> Column:
    """(score, issue): 0.6 for a low resolution, 1 otherwise."""
    low = (width < 800) | (height < 600)
    return F.struct(F.when(low, 0.6).otherwise(1.0).alias("score"), F.when(low, "Low resolution").alias("issue"))


def scanned_text_flag(first_page: Column, has_images: Column) -> Column:
    """A first page with under 50 characters, or under 100 beside images, is taken as scanned."""
    n = F.length(F.btrim(F.coalesce(first_page, F.lit(""))))
    return (n < 50) | ((n < 100) & has_images)


def extractor_route(kind: Column, scanned: Column, text: Column) -> Column:
    """Which reader a file goes to: garbled digital text goes back to OCR; null for unknown kinds."""
    return F.when(kind == "pdf", F.when(scanned | garbage_text(text), "ocr").otherwise("pdf")).when(kind == "docx", "docx").when(kind == "image", "ocr")


def readable_filter(files: DataFrame, issues: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Files without issues, and the others with theirs."""
    bad = F.size(issues) > 0
    return files.filter(~bad), files.filter(bad)
