"""The catalogue as it is kept: a folder per table, a partition per batch, so that a batch can be written again and rows can be removed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators.catalogue import delete_cascade


def sink_catalogue(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """Write the tables of a batch. Written again under its name, a batch takes its own place, so a rerun after a failure adds nothing twice."""
    for name, df in tables.items():
        df.drop("batch").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read_catalogue(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The kept tables with the batch of each row."""
    return {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string")) for name in names}


def delete_stored(spark: SparkSession, path: str, names: list[str], ids: DataFrame) -> list[str]:
    """Remove the extractions of ids (column id) with all that belongs to them, and return the batches that were rewritten.

    Only batches that hold one of the ids are rewritten; what stays of them is laid aside in full first, so a failure in between loses
    nothing and the removal can be run again. The audit log is left alone.
    """
    kept = read_catalogue(spark, path, names)
    touched = sorted(r.batch for r in kept["extractions"].join(ids.select("id"), "id", "left_semi").select("batch").distinct().collect())
    rest = delete_cascade({n: df.filter(F.col("batch").isin(touched)) for n, df in kept.items()}, ids)
    aside = f"{path}/_removed/{uuid.uuid4().hex}"
    changed = [n for n in names if "extraction_id" in kept[n].columns or n == "extractions"]
    for name in changed if touched else []:
        rest[name].write.partitionBy("batch").parquet(f"{aside}/{name}")
    # the extractions go last: as long as they are there, the removal can be repeated
    for name in sorted(changed, key=lambda n: n == "extractions") if touched else []:
        schema = kept[name].schema
        for batch in touched:
            left = spark.read.schema(schema).parquet(f"{aside}/{name}").filter(F.col("batch") == batch).drop("batch")
            left.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    return touched
