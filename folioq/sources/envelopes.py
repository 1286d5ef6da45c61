"""Extraction envelopes: JSON files in, JSON and CSV out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.json import strict
from folioq.functions.variants import bound


def scan_json_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(path, record variant, status) of one JSON document per file; broken ones have status error and a null record."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strict(F.col("value")).alias("record"))
    return raw.withColumn("status", F.when(F.col("record").isNull(), "error").otherwise("success"))


def scan_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header as (path, columns as text)."""
    return spark.read.option("header", True).csv(path).withColumn("path", F.col("_metadata.file_path"))


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


#: Types of the envelope's rows after a dispatch by suffix.
FAILED = "Unsupported file type"


def scan_csv_wrapped(spark: SparkSession, path: str) -> DataFrame:
    """(path, record variant): one record per file with its rows as maps of texts and the format it came from."""
    rows = scan_csv_rows(spark, path)
    fields = [c for c in rows.columns if c != "path"]
    grouped = rows.groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    return grouped.select("path", F.to_variant_object(F.struct("rows", F.lit("csv").alias("_source_format"))).alias("record"))


#: A cell of a CSV text with what ends it: quoted, with line breaks and doubled quotes, or plain.
CELL = r'((?:"(?:[^"]++|"")*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|))(,|\r?\n)'


def csv_rows(text: Column) -> Column:
    """Array of rows of cells of a CSV text, empty lines left out; null where a quote is never closed. Quotes follow the usual rules: they hold
    commas and line breaks, are doubled inside, and mean nothing within a plain cell."""

    def parsed(text: Column) -> Column:
        cells = F.regexp_extract_all(text, F.lit(CELL), F.lit(0))

        def rows(cells: Column) -> Column:
            ends = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: F.get(cells, i).endswith("\n"))
            cut = lambda first, last: F.transform(F.slice(cells, first + 1, last - first + 1), bare)
            split = bound(ends, lambda ends: F.transform(ends, lambda e, j: cut(F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1), e)))
            whole = F.length(F.array_join(cells, "")) == F.length(text)
            return F.when(whole, F.filter(split, lambda r: (F.size(r) > 1) | (F.get(r, F.lit(0)) != "")))

        return bound(cells, rows)

    def bare(cell: Column) -> Column:
        own = F.regexp_replace(cell, r"(,|\r?\n)\z", "")
        quoted = F.concat(F.replace(F.regexp_extract(own, r'(?s)^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"')), F.regexp_extract(own, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1))
        return F.when(own.startswith('"'), quoted).otherwise(own)

    return bound(F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))), parsed)


def scan_dispatch(files: DataFrame) -> DataFrame:
    """(path, record, status, error) of (path, content): JSON by its suffix, CSV as its header and rows, anything else failed.

    A broken file is an error row and stops nothing. Of columns that share a name the last one counts, missing cells are null, and cells beyond the
    header are left out. A null content is broken.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))

    def mapped(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        last = lambda name: F.size(head) - F.array_position(F.reverse(head), name).cast("int")
        return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.array_distinct(head), F.transform(F.array_distinct(head), lambda name: F.get(r, last(name)))))

    rows = bound(csv_rows(F.col("content")), mapped)
    csv = F.to_json(F.struct(F.coalesce(rows, F.array().cast("array<map<string,string>>")).alias("rows"), F.lit("csv").alias("_source_format")), {"ignoreNullFields": "false"})
    broken = csv_rows(F.col("content")).isNull()
    record = F.when(ext == ".json", strict(F.col("content"))).when((ext == ".csv") & ~broken, F.parse_json(csv))
    error = F.when(~ext.isin(".json", ".csv"), FAILED).when(record.isNull(), F.when(ext == ".csv", "Invalid CSV").otherwise("Invalid JSON"))
    return files.select("path", record.alias("record"), F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error"))


def batch_extract(inputs: DataFrame, text_col: str = "content") -> DataFrame:
    """inputs with status, error, length and word_count: an item without text becomes an error row instead of stopping the batch."""
    bad = F.col(text_col).isNull() | (F.btrim(text_col) == "")
    words = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"(?U)\S+")).cast("long")
    return inputs.withColumns({"status": F.when(bad, "error").otherwise("success"), "error": F.when(bad, "No text"), "length": F.coalesce(F.length(text_col), F.lit(0)).cast("long"), "word_count": words})


def sink_reports(reports: DataFrame, path: str, run_ts: str, kind: str = "document_type") -> None:
    """Append audit reports under their type, with the time of the run."""
    reports.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy(kind).parquet(path)
