"""Exact length histogram: documents by encoded length, and suffix sums over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioq.llm.bpe import token_lengths

#: Limits that are answered even if no document has that length.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072)
#: Lengths that share one block of the two-level suffix sum.
BLOCK = 1024


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length. Null texts have length 0."""
    return token_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_report(histogram: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """For every occurring length and every given limit taken as context limit, the answers a planner needs.

    Per limit L: n_docs of that length; docs_within and tokens_within for documents that fit; docs_over for those
    that do not; truncated_tokens, the sum of min(length, L); total_tokens; quantile, the share of documents that
    fit. The suffix sums run in blocks of lengths, so no task sees more than BLOCK lengths or the block totals.
    Rows of one length are added up; lengths and counts that are null are left out. An empty histogram gives an empty report.
    The histogram is read twice, so an expensive one should be stored first.
    """
    known = histogram.select(F.col("n_tokens").cast("long"), F.col("n_docs").cast("long")).filter("n_tokens is not null and n_docs is not null")
    asked = known.limit(1).select(F.explode(F.array(*map(F.lit, limits)).cast("array<long>")).alias("n_tokens"), F.lit(0).cast("long").alias("n_docs")) if limits else known.limit(0)
    h = known.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).select(
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_docs").cast("long").alias("n_docs"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(all_blocks).alias("all_docs"),
        F.sum("tokens").over(all_blocks).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.select(
        "n_tokens",
        "n_docs",
        "block",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0)).alias("tokens_longer"),
    ).join(blocks, "block")
    over, over_tokens = F.col("docs_longer") + F.col("docs_above"), F.col("tokens_longer") + F.col("tokens_above")
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("all_docs") - over).alias("docs_within"),
        over.alias("docs_over"),
        (F.col("all_tokens") - over_tokens).alias("tokens_within"),
        (F.col("all_tokens") - over_tokens + over * F.col("n_tokens")).alias("truncated_tokens"),
        F.col("all_tokens").alias("total_tokens"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("quantile"),
    )


def limit_answers(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The report's rows for just these limits, whichever they are."""
    return context_report(histogram, limits).filter(F.col("context_limit").isin(*limits))


def quantile_lengths(report: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(quantile, n_tokens): the least length within which at least that share of the documents fits; null for an empty report."""
    least = [F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when((F.col("quantile") >= q) & (F.col("n_docs") > 0), F.col("context_limit"))).alias("n_tokens")) for q in quantiles]
    return report.agg(F.array(*least).alias("x")).select(F.inline("x"))
