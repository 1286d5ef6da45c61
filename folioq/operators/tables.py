"""Tables read from documents: cells to headers and rows, validity, duplicates, numbering, merged cells.

A raw table is an array of rows of cells, the first row being the headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_table(rows: Column) -> Column:
    """(headers, rows, data, row_count, col_count): null cells are empty, data has a map per row as wide as the headers.

    Of headers that repeat, the last cell counts.
    """
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))

    def of(t: Column) -> Column:
        headers, body = F.coalesce(F.get(t, 0), F.array().cast("array<string>")), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
        last = lambda r: F.filter(F.arrays_zip(headers.alias("h"), r.alias("c"), F.sequence(F.lit(1), F.size(headers)).alias("i")), lambda x: ~F.exists(F.slice(headers, x["i"] + 1, F.size(headers)), lambda h: h == x["h"]))
        data = F.transform(F.filter(body, lambda r: (F.size(r) == F.size(headers)) & (F.size(headers) > 0)), lambda r: F.map_from_entries(F.transform(last(r), lambda x: F.struct(x["h"], x["c"]))))
        return F.struct(headers.alias("headers"), body.alias("rows"), data.alias("data"), F.size(body).alias("row_count"), F.size(headers).alias("col_count"))

    return F.element_at(F.transform(F.array(clean), of), 1)


def blank(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.btrim(c) == ""))


def table_cell_stats(table: Column) -> Column:
    """(empty_headers, empty_cells, total_cells)."""
    return F.struct(blank(table["headers"]).alias("empty_headers"), blank(F.flatten(table["rows"])).alias("empty_cells"), (table["row_count"] * table["col_count"]).alias("total_cells"))


def validate_table(table: Column) -> Column:
    """At least one row and two columns, at most half of the headers and four fifths of the cells empty."""
    stats = table_cell_stats(table)
    shape = (table["row_count"] >= 1) & (table["col_count"] >= 2)
    return shape & (stats["empty_headers"] <= F.size(table["headers"]) * 0.5) & ~((stats["total_cells"] > 0) & (stats["empty_cells"] > 0.8 * stats["total_cells"]))


def validate_docx_table(table: Column) -> Column:
    return (table["row_count"] >= 1) & (table["col_count"] >= 2)


def table_dedup(tables: DataFrame, doc: str, order: str, table: str = "table") -> DataFrame:
    """The first of a document's tables with the same size and first three headers, numbered anew from 1 as table_num.

    The first is found by a partially aggregated arg-min; the window numbers what is left of one document.
    """
    t = F.col(table)
    keyed = tables.withColumn("_sig", F.concat_ws("\x1f", t["row_count"], t["col_count"], F.slice(t["headers"], 1, 3)))
    first = keyed.groupBy(doc, "_sig").agg(F.min_by(F.struct(*tables.columns), order).alias("_t")).select("_t.*")
    return table_renumber(first, doc, order)


def table_renumber(tables: DataFrame, doc: str, order: str) -> DataFrame:
    return tables.withColumn("table_num", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def union_backends(first: DataFrame, second: DataFrame, doc: str) -> DataFrame:
    """The first reader's tables, and the second's for documents of which the first has none."""
    return first.unionByName(second.join(first.select(doc).distinct(), doc, "left_anti"))


def merge_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per table: total_cells, merged_cells, has_merged_cells, from cells with row_span and col_span."""
    merged = (F.col("row_span") > 1) | (F.col("col_span") > 1)
    return cells.groupBy(*keys).agg(F.count("*").alias("total_cells"), F.count_if(merged).alias("merged_cells")).withColumn("has_merged_cells", F.col("merged_cells") > 0)


def doc_merge_tables(stats: DataFrame, doc: str) -> DataFrame:
    """Per document how many tables have merged cells."""
    return stats.groupBy(doc).agg(F.count_if("has_merged_cells").alias("tables_with_merged_cells"))


def merged_regions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_row, start_col, end_row, end_col, cell_count) of every merged cell."""
    wide = cells.filter((F.col("row_span") > 1) | (F.col("col_span") > 1))
    return wide.select(*keys, F.col("row").alias("start_row"), F.col("col").alias("start_col"), (F.col("row") + F.col("row_span") - 1).alias("end_row"), (F.col("col") + F.col("col_span") - 1).alias("end_col"), (F.col("row_span") * F.col("col_span")).alias("cell_count"))


def best_ocr_candidate(tries: DataFrame, page: str = "page", order: str = "try_no") -> DataFrame:
    """Per page the reading that wins: readings in order, a strictly higher confidence takes over, and from confidence 85 with 250
    characters on no further one is looked at. Needs columns confidence and chars."""
    so_far = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct("confidence", (-F.col(order)).alias("_try"), "chars")).over(so_far)
    enough = tries.withColumn("_best", best).withColumn("_stop", (F.col("_best.confidence") >= 85) & (F.col("_best.chars") >= 250))
    stop = F.min(F.when(F.col("_stop"), F.col(order))).over(Window.partitionBy(page))
    looked = enough.withColumn("_end", stop).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return looked.groupBy(page).agg(F.max("_best").alias("b")).select(page, (-F.col("b._try")).alias(order), F.col("b.confidence").alias("confidence"), F.col("b.chars").alias("chars"))


def ocr_page_mean(words: DataFrame, page: str, confidence: str) -> DataFrame:
    """Mean of the positive word confidences of every page, 0 without any."""
    return words.groupBy(page).agg(F.coalesce(F.avg(F.when(F.col(confidence) > 0, F.col(confidence))), F.lit(0.0)).alias("mean_confidence"))


def running_balance(rows: DataFrame, account: str, order: list[str], amount: str, balance: str, opening: Column | None = None) -> DataFrame:
    """rows with expected_balance, the balance before plus the amount, and follows; the first of an account starts from opening."""
    before = F.lag(balance).over(Window.partitionBy(account).orderBy(*order))
    expected = F.coalesce(before, opening if opening is not None else F.col(balance) - F.col(amount)) + F.col(amount)
    return rows.withColumn("expected_balance", expected).withColumn("follows", F.abs(F.col("expected_balance") - F.col(balance)) <= 0.01)
