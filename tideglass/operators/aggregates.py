"""Portfolio, metric and quality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import QUALITY_STATES, from_rank, ladder, rank_in, safe_ratio
from tideglass.operators.ordered import exact_median, ranked_values


def portfolio_cube(facts: DataFrame, dims: list[str], measures: list[Column], how: str = "cube") -> DataFrame:
    """Totals for every combination of the dimensions; ``level`` tells rolled-up from missing."""
    grouped = facts.cube(*dims) if how == "cube" else facts.rollup(*dims)
    return grouped.agg(F.grouping_id().alias("level"), *measures)


def signal_metrics(signals: DataFrame, by: list[str]) -> DataFrame:
    """Volume, disposition rates and precision. Rows have decision (null = open)."""
    d = F.col("decision")
    share = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    out = signals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("alerts"), share(d.isNotNull()).alias("decided"), share(d == "ACCEPT").alias("accepted"),
        share(d == "MARK_FALSE_POSITIVE").alias("false_positives"),
    )
    return out.withColumn("precision", F.round(safe_ratio(F.col("accepted"), F.col("decided")), 6)).withColumn(
        "false_positive_rate", F.round(safe_ratio(F.col("false_positives"), F.col("decided")), 6)
    )


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_median(ranked_values(df, keys, value), keys, value)


def worst_quality(df: DataFrame, by: list[str], state: str, contributor: str) -> DataFrame:
    """Worst quality state per group and how many contributors it excludes."""
    rank = rank_in(F.col(state), QUALITY_STATES)
    bad = F.col(state).isin("STALE", "INSUFFICIENT")
    return df.groupBy(*by).agg(
        F.max(rank).alias("_r"), F.count(F.lit(1)).alias("contributors"), F.sum(bad.cast("int")).alias("excluded"),
        F.count_distinct(F.when(bad, F.col(contributor))).alias("excluded_distinct"),
    ).withColumn("worst_quality", from_rank(F.col("_r"), QUALITY_STATES)).drop("_r")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def confidence(components: list[Column], method: str) -> Column:
    """Normalised confidence of the present components: the minimum or their mean."""
    present = F.filter(F.array(*components), lambda c: c.isNotNull())
    if method == "MINIMUM":
        return F.array_min(present)
    total = F.aggregate(present, F.lit(0.0), lambda acc, c: acc + c.cast("double"))
    return F.when(F.size(present) > 0, total / F.size(present))


def materiality(amount: Column, denominator: Column, cuts: list[tuple[float, str]]) -> tuple[Column, Column]:
    """(share, band) of an amount against a governed denominator; no band without a denominator."""
    share = safe_ratio(amount, denominator)
    return share, F.when(share.isNotNull(), ladder(share, cuts, "LOW"))


def population_stability(df: DataFrame, bucket: str, period: str, first: str, second: str) -> DataFrame:
    """Share of each bucket in two periods and its part of the stability index; absent buckets count half a row."""
    counts = df.groupBy(bucket).agg(
        F.sum((F.col(period) == first).cast("int")).alias("n_a"), F.sum((F.col(period) == second).cast("int")).alias("n_b")
    )
    total = df.agg(
        F.sum((F.col(period) == first).cast("int")).alias("t_a"), F.sum((F.col(period) == second).cast("int")).alias("t_b")
    ).withColumn("_one", F.lit(1))
    half = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double")).otherwise(0.5)
    a, b = half("n_a") / F.col("t_a"), half("n_b") / F.col("t_b")
    # The totals are one row whatever the data, as an ungrouped aggregate gives one row.
    both = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return both.select(bucket, "n_a", "n_b", ((a - b) * F.log(a / b)).alias("stability"))
