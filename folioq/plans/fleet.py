"""Queries over kept sketches of the fleet's quality, with SQL from the records themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import fleet
from folioq.operators.validation import validate_invoices
from folioq.plans.audits import AUDIT, invoices
from folioq.plans.base import query, read, scratch


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of all orders with their customers as owners, written once."""
    owners = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"))
    path = scratch(spark)
    validate_invoices(invoices(spark, sf_dir)).select("doc_id", "document_type", "day", "score", "is_valid").join(owners, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def kept(spark: SparkSession, audited: DataFrame) -> DataFrame:
    """Sketches by type and day of three batches, of which one comes twice."""
    path = scratch(spark)
    for turn in (0, 1, 2, 1):
        fleet.keep_sketches(fleet.daily_sketches(audited.filter(F.col("doc_id") % 3 == turn), F.to_date("day"), ["document_type"], "owner"), path, f"b{turn}")
    return spark.read.parquet(path)


@query(AUDIT + """SELECT document_type, CAST(date_trunc('month', day) AS DATE) AS month, count(*)::BIGINT n_docs, count(*) FILTER (is_valid)::BIGINT n_valid, round(count(*) FILTER (is_valid) / count(*), 4) valid_share, round(CAST(sum(CAST(score AS DECIMAL(18,8))) AS DOUBLE) / count(*), 4) mean_score,
true AS owners_within, true AS median_within FROM r GROUP BY GROUPING SETS ((1, 2), (2))""")  # fmt: skip
def fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months by type, and over all types, from kept days. The estimates are held to the exact owners and ranks of the same records, within the stated bounds."""
    audited = reports(spark, sf_dir)
    by_type = fleet.roll_up(kept(spark, audited), ["document_type"], F.trunc("day", "month").cast("date"))
    total = fleet.roll_up(by_type, [], F.col("day")).withColumn("document_type", F.lit(None).cast("string"))
    told = fleet.answers(by_type.unionByName(total)).withColumnRenamed("day", "month")
    monthly = audited.select("document_type", F.trunc("day", "month").alias("month"), "owner", "score")
    both = monthly.unionByName(monthly.withColumn("document_type", F.lit(None).cast("string")))
    medians = told.select(F.col("document_type").alias("t"), F.col("month").alias("m"), "median_score")
    same = F.col("document_type").eqNullSafe(F.col("t")) & F.col("month").eqNullSafe(F.col("m"))
    ranks = both.join(medians, same).groupBy("t", "m").agg(F.count_distinct("owner").alias("exact"), F.avg((F.col("score") < F.col("median_score")).cast("double")).alias("below"), F.avg((F.col("score") <= F.col("median_score")).cast("double")).alias("upto"))
    near = F.abs(F.col("n_owners") - F.col("exact")) <= F.greatest(F.lit(1.0), fleet.OWNER_BOUND * F.col("exact"))
    middle = (F.col("below") <= 0.5 + fleet.RANK_BOUND) & (F.col("upto") >= 0.5 - fleet.RANK_BOUND)
    return told.join(ranks, same).select("document_type", "month", "n_docs", "n_valid", "valid_share", "mean_score", near.alias("owners_within"), middle.alias("median_within"))
