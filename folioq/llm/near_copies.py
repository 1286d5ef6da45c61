"""The pipeline's near copies: five-word shingles of a Jaccard similarity of 0.8 or more.

They are linked by SimHash fingerprints that differ in two bits or fewer, then by the forest of MinHash signatures, as similar sets may differ in
more bits; links are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioq.llm.common import fresh
from folioq.llm.forest import classes_of, digest, shingles

WIDTH = 5


def components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) of every row, v being the digest of its shingles, and (v, best) of every v: best (none, id, v) is the least row of its
    component by id, rows without one last. Texts without words are one component."""
    rows, named = classes_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), WIDTH, prints=True)
    bare = rows.filter("n = 0").groupBy("v").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("rep")).withColumn("root", F.col("v"))
    all_named = named.unionByName(bare)
    best = all_named.groupBy("root").agg(F.min(F.struct("rep.none", "rep.id", "v")).alias("best"))
    return rows, all_named.join(best, "root").select("v", "best")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) per row: the smallest id reachable by links between near copies.

    Texts with the same shingles are one class. Null and empty texts are copies of each other. Rows with a null id link like
    all others; a component without any id has none. Repeated rows are reported each, very long texts are compared whole.
    """
    rows, known = components(docs, id_col, text_col)
    return rows.join(known, "v").select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"))


def row_key(v: Column, id_text: Column) -> Column:
    """The digest of a row's shingles, of 16 bytes, with its id behind; a null id leaves nothing behind, any other a mark and its text."""
    return F.concat(v, F.coalesce(F.concat(F.lit("="), id_text), F.lit("")).cast("binary"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, all columns kept: that with the smallest id, rows without one last.

    Rows are told apart by id and shingles, so unrelated texts that share an id are judged apart; of rows that agree in both, the
    one with the least hash over its columns stays, whatever the partitions. Columns may have any name.
    """
    _, known = components(docs, id_col, text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    mark = fresh("v", names)
    own, whose = fresh("key", [*names, mark]), F.col(f"`{id_col}`").cast("string")
    best = known.select(row_key(F.col("best.v"), F.col("best.id").cast("string")).alias(own)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([digest(shingles(t.as_py(), WIDTH)) for t in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sets], [*names, mark])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())])).withColumn(own, row_key(F.col(mark), whose)).drop(mark)
    # one key for join and grouping, and a merge join, so that the texts are shuffled once
    kept = marked.join(best.hint("merge"), own, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    one = kept.groupBy(own).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.xxhash64(*plain)).alias("row"))
    return one.select("row.*")
