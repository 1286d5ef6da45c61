"""Sketches of the fleet's quality: merged answers against exact ones, reruns, odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from folioq.operators import fleet

DAY = dt.date(2024, 1, 30)


def reports(spark, n):
    """n reports over forty days and three types; a third come from one owner."""
    i = F.col("id")
    owner = F.when(i % 3 == 0, F.lit(0)).otherwise(i % 70_001)
    return spark.range(n).select(i, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (i % 3 + 1).cast("int")).alias("kind"), F.date_add(F.lit(DAY), (i % 40).cast("int")).alias("day"), owner.alias("owner"), (F.pmod(F.hash(i), F.lit(10_007)) / 10_007).alias("score"), (i % 4 > 0).alias("is_valid"))


def test_merged_answers_stay_within_their_bounds(spark, tmp_path):
    df = reports(spark, 300_000)
    for turn in (0, 1, 1):
        fleet.keep_sketches(fleet.daily_sketches(df.filter(F.col("id") % 2 == turn), F.col("day"), ["kind"], "owner"), str(tmp_path), f"b{turn}")
    quantiles = {"low": 0.1, "median": 0.5, "high": 0.99}
    monthly = fleet.roll_up(spark.read.parquet(str(tmp_path)), ["kind"], F.trunc("day", "month").cast("date"))
    whole = fleet.answers(fleet.roll_up(monthly, []), quantiles).first()
    assert (whole.n_docs, whole.n_valid, whole.n_scored) == (300_000, 225_000, 300_000)
    exact = df.select("owner").distinct().count()
    assert abs(whole.n_owners - exact) <= fleet.OWNER_BOUND * exact
    for name, q in quantiles.items():
        upto = df.filter(F.col("score") <= whole[name]).count() / 300_000
        assert abs(upto - q) <= fleet.RANK_BOUND
    assert abs(whole.mean_score - df.agg(F.avg("score").alias("m")).first().m) < 1e-4
    got = {(r.kind, r.day): (r.n_docs, r.n_valid) for r in fleet.answers(monthly).collect()}
    want = df.groupBy("kind", F.trunc("day", "month").alias("m")).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v")).collect()
    assert got == {(r.kind, r.m): (r.n, r.v) for r in want}


def test_odd_reports(spark):
    df = spark.createDataFrame([("a", None, None, None, None), ("a", None, "x", 0.5, True), ("b", DAY, None, None, False), ("b", DAY, None, None, False)], "owners string, day date, owner string, score double, is_valid boolean")
    days = fleet.daily_sketches(df.withColumnRenamed("owners", "kind"), F.col("day"), ["kind"], "owner")
    got = {(r.kind, r.day): (r.n_docs, r.n_valid, r.mean_score, r.n_owners, r.median_score) for r in fleet.answers(days).collect()}
    assert got == {("a", None): (2, 1, 0.5, 1, 0.5), ("b", DAY): (2, 0, None, 0, None)}
    none = fleet.daily_sketches(df.limit(0), F.col("day"), [], "owner")
    assert fleet.roll_up(fleet.daily_sketches(df.limit(0), F.col("day"), ["is_valid"], "owner"), ["is_valid"]).count() == 0 and none.count() == 0


def test_means_are_rounded_by_their_double(spark):
    df = spark.createDataFrame([("a", DAY, "x", 0.5024, True), ("a", DAY, "y", 0.5025, True)], "kind string, day date, owner string, score double, is_valid boolean")
    assert fleet.answers(fleet.daily_sketches(df, F.col("day"), ["kind"], "owner")).first().mean_score == 0.5024  # round(0.50245, 4) in SQL


def test_means_at_a_half_go_as_in_sql(spark):
    import duckdb

    pairs = [(0.0567, 0.1178), (0.0567, 0.25), (0.0567, 0.356), (0.0567, 0.4336), (0.0567, 0.4426)]
    df = spark.createDataFrame([(i, x) for i, pair in enumerate(pairs) for x in pair] + [(9, None)], "i int, score double")
    got = {r.i: r.m for r in df.groupBy("i").agg(fleet.mean_score(F.col("score")).alias("m")).collect()}
    want = [duckdb.sql(f"SELECT round(avg(x), 4) FROM (VALUES (CAST({a} AS DOUBLE)), ({b})) t(x)").fetchall()[0][0] for a, b in pairs]
    assert got == {**dict(enumerate(want)), 9: None}  # round(avg(score), 4) in Spark gives 0.0873 for the first
