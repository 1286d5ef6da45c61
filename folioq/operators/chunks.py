"""Records extracted chunk by chunk, merged into one per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


def filled(value: Column) -> Column:
    return value.isNotNull() & (value.cast("string") != "")


def chunk_merge_first(chunks: DataFrame, id_col: str, chunk_col: str, fields: list[str]) -> DataFrame:
    """Per document the first value of each field that is neither null nor empty, by chunk; a partially aggregated arg-min."""
    first = [F.min_by(F.when(filled(F.col(f)), F.col(f)), F.when(filled(F.col(f)), F.col(chunk_col))).alias(f) for f in fields]
    return chunks.groupBy(id_col).agg(*first)


def chunk_list_union(items: DataFrame, id_col: str, chunk_col: str, pos_col: str, item_col: str, out: str = "items") -> DataFrame:
    """Per document the items in order, without those that an earlier chunk already had; repeats inside a chunk stay."""
    first = F.min(chunk_col).over(Window.partitionBy(id_col, item_col))
    kept = items.withColumn("_first", first).filter(F.col(chunk_col) == F.col("_first"))
    listed = F.array_sort(F.collect_list(F.struct(chunk_col, pos_col, item_col)))
    return kept.groupBy(id_col).agg(F.transform(listed, lambda x: x[item_col]).alias(out))


def merge_records(chunks: DataFrame, id_col: str, chunk_col: str, fields: list[str], lists: list[str]) -> DataFrame:
    """One record per document: fields by their first value, lists by union, and how many chunks went in."""
    out = chunk_merge_first(chunks, id_col, chunk_col, fields)
    counts = chunks.groupBy(id_col).agg(F.lit(True).alias("_chunked_extraction"), F.count_distinct(chunk_col).alias("_chunks_processed"))
    out = out.join(counts, id_col)
    for name in lists:
        items = chunks.select(id_col, chunk_col, F.posexplode(name).alias("_pos", "_item"))
        out = out.join(chunk_list_union(items, id_col, chunk_col, "_pos", "_item", name), id_col, "left")
    return out


def parts_of(kind: DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], DataType]]:
    """Every field of a record's type with its path, objects before what they hold."""
    inner = [x for f in kind.fields for x in parts_of(f.dataType, (*path, f.name))] if isinstance(kind, StructType) else []
    return [(path, kind), *inner]


def merge_nested(chunks: DataFrame, id_col: str, chunk_col: str, record_col: str) -> DataFrame:
    """(id, record, _chunked_extraction, _chunks_processed): the records of a document's chunks merged at every depth of their type.

    A value is the first that is neither null nor an empty text, else the last one; a list is the union of the chunks' lists in their order, without items
    that an earlier chunk already had (repeats inside a chunk stay); an object is merged field by field. Values are partially aggregated
    minima; items are told apart by a window on the item, so only the merged lists are ever brought together. A null record adds nothing; documents with none
    but null records have a null record. Chunks without a number come last.
    """
    kind = chunks.schema[record_col].dataType
    parts = parts_of(kind)
    at = lambda path: reduce(lambda c, f: c[f], path, F.col("record"))
    src = chunks.select(F.col(id_col).alias("id"), F.col(chunk_col).alias("given"), F.struct(F.col(chunk_col).isNull().alias("none"), F.col(chunk_col).alias("chunk")).alias("chunk"), F.col(record_col).alias("record"))
    values = []
    for n, (path, of) in enumerate(parts):
        x = at(path)
        if isinstance(of, StructType | ArrayType):
            values.append(F.max(x.isNotNull()).alias(f"p{n}"))
        else:
            good = (x.isNotNull() & (x != "")) if isinstance(of, StringType) else x.isNotNull()
            values.append(F.coalesce(F.min_by(F.when(good, x), F.when(good, F.col("chunk"))), F.max_by(x, F.when(at(path[:-1]).isNotNull(), F.col("chunk")))).alias(f"p{n}"))
    out = src.groupBy("id").agg(*values, F.count_distinct("given").alias("_chunks_processed"))
    lists = [n for n, (_, of) in enumerate(parts) if isinstance(of, ArrayType)]
    if lists:
        told = lambda n: F.transform(at(parts[n][0]), lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"}))
        rows = src.select("id", "chunk", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), told(n).alias("items")) for n in lists])).alias("l")).select("id", "chunk", "l.part", F.posexplode("l.items").alias("pos", "item"))
        first = rows.withColumn("first", F.min("chunk").over(Window.partitionBy("id", "part", "item"))).filter(F.col("chunk") == F.col("first"))
        joined = first.groupBy("id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pos", "item"))), lambda x: x["item"]).alias("items"))
        found = joined.groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("part", "items"))).alias("lists"))
        out = out.join(found, F.col("id").eqNullSafe(F.col("of")), "left")

    def built(path: tuple[str, ...]) -> Column:
        n, of = next((n, of) for n, (p, of) in enumerate(parts) if p == path)
        if isinstance(of, StructType):
            return F.when(F.col(f"p{n}"), F.struct(*[built((*path, f.name)).alias(f.name) for f in of.fields]))
        if isinstance(of, ArrayType):
            read = F.transform(F.try_element_at("lists", F.lit(n)), lambda j: F.from_json(j, StructType().add("x", of.elementType))["x"])
            return F.when(F.col(f"p{n}"), F.coalesce(read, F.array().cast(of)))
        return F.col(f"p{n}")

    return out.select(F.col("id").alias(id_col), built(()).alias(record_col), F.lit(True).alias("_chunked_extraction"), "_chunks_processed")
