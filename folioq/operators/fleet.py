"""Quality of a fleet of documents, kept by day as sketches that merge, so that months and years follow without reading a record again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^LG_OWNERS registers count owners, with a standard error of 1.04 / sqrt(2^LG_OWNERS): 1.6 %. A sketch takes at most about 4 KB.
LG_OWNERS = 12
#: Size of the quantile sketches; a rank is off by at most 1.65 % of the rows with 99 % confidence. A sketch takes a few KB and grows with the logarithm of its rows.
K_SCORES = 200
#: Bounds that a test can hold the answers to: four standard errors of a count, three times the stated error of a rank.
OWNER_BOUND, RANK_BOUND = 4 * 1.04 / 2 ** (LG_OWNERS / 2), 0.05


def nearest(x: Column) -> Column:
    """At four decimals as the double itself decides: 0.50245 lies below its half, while round(x, 4) takes its shortest decimal and goes up."""
    return F.round(x * 10000) / 10000


def mean_score(score: Column) -> Column:
    """Mean of scores at four decimals, from their exact sum, so that neither order nor partitions decide; null without any."""
    return nearest(F.try_divide(F.sum(score.cast("decimal(18,8)")).cast("double"), F.count(score).cast("double")))


def daily_sketches(reports: DataFrame, day: Column, by: list[str], owner: str, score: str = "score", valid: str = "is_valid") -> DataFrame:
    """(by..., day, n_docs, n_valid, n_scored, total_score, owners, scores): one row per group and day of audit reports.

    Sums are decimals, so they add up alike in any order; a score is taken at eight decimals. Reports without a day are a day of their own; a null owner or score
    is left out of its sketch, and a null validity is not valid. No rows give no rows. Sketches are built in the tasks before the shuffle.
    """
    exact = F.col(score).cast("decimal(18,8)")
    return reports.groupBy(*by, day.alias("day")).agg(
        F.count("*").alias("n_docs"), F.count_if(F.coalesce(F.col(valid), F.lit(False))).alias("n_valid"), F.count(score).alias("n_scored"), F.coalesce(F.sum(exact), F.lit(0)).cast("decimal(38,8)").alias("total_score"),
        F.hll_sketch_agg(F.col(owner).cast("string"), LG_OWNERS).alias("owners"), F.kll_sketch_agg_double(F.col(score).cast("double"), K_SCORES).alias("scores"),
    )


def roll_up(sketches: DataFrame, by: list[str], period: Column | None = None) -> DataFrame:
    """Sketches merged over other groups: days into periods, if one is given, and types into any subset of their columns. What it returns can be rolled up again."""
    keys = list(by) + ([period.alias("day")] if period is not None else [])
    return sketches.groupBy(*keys).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_valid").alias("n_valid"), F.sum("n_scored").alias("n_scored"), F.sum("total_score").cast("decimal(38,8)").alias("total_score"),
        F.hll_union_agg("owners").alias("owners"), F.kll_merge_agg_double("scores", K_SCORES).alias("scores"),
    )


def answers(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Sketches read out: valid share, mean score, owners and quantiles of scores (null where nothing has a score); counts stay."""
    quantiles = {"median_score": 0.5} if quantiles is None else quantiles
    read = {name: F.when(F.col("n_scored") > 0, F.kll_sketch_get_quantile_double("scores", F.lit(q))) for name, q in quantiles.items()}
    mean = nearest(F.try_divide(F.col("total_score").cast("double"), F.col("n_scored").cast("double")))
    counted = {"valid_share": nearest(F.col("n_valid") / F.col("n_docs")), "mean_score": mean, "n_owners": F.hll_sketch_estimate("owners")}
    return sketches.withColumns({**counted, **read}).drop("owners", "scores", "total_score")


def keep_sketches(sketches: DataFrame, path: str, batch: str) -> None:
    """Keep the sketches of a batch of reports below a path. A batch that is written again takes its own place, so a rerun counts nothing twice; a day
    may come in any number of batches, as its sketches merge."""
    sketches.write.mode("overwrite").parquet(f"{path}/batch={batch}")
