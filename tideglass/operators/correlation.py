"""Correlation hypotheses: gated contributors, lineage collapse, counts, confidence, life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.functions.scalars import days_us, floor_div, micros
from tideglass.sources.reference import values


@dataclass(frozen=True)
class CorrelationPolicy:
    policy_id: str
    hypothesis_type: str
    window_days: int
    minimum_families: int
    families: dict[str, str]
    contradicting: tuple[str, ...] = ()
    contradiction_mode: str = "REDUCE_CONFIDENCE"
    confidence_method: str = "BOUNDED_RULE"
    materiality: str = "HIGH"
    excluded_statuses: tuple[str, ...] = ("REJECTED", "CLOSED", "EXPIRED", "SUPERSEDED")
    excluded_tags: tuple[str, ...] = ("FALSE_POSITIVE", "DUPLICATE", "INSUFFICIENT_EVIDENCE")
    excluded_quality: tuple[str, ...] = ("STALE", "INSUFFICIENT")


# The reference liquidity policy.
LIQUIDITY = CorrelationPolicy(
    "CORR-POL-EMERGING-LIQUIDITY-STRESS-001", "EMERGING_LIQUIDITY_STRESS", 30, 2,
    {
        "REPEATED_PAYMENT_RETURN": "PAYMENT_RETURN", "DPD_DERIORATION": "DELINQUENCY",
        "UTILIZATION_HIGH": "UTILIZATION_PRESSURE", "UTILIZATION_SPIKE": "UTILIZATION_PRESSURE",
    },
    contradicting=("PAYMENT_CURED",),
)

HYPOTHESIS = ["hypothesis_type", "counterparty_id", "as_of"]


def candidates(contributors: DataFrame, policy: CorrelationPolicy) -> DataFrame:
    """Contributors that pass the quality gate, with family, role and the evaluation they fall in.

    Hypotheses are evaluated once per policy window, at its end; every contributor of the window
    (as_of - window, as_of] belongs to exactly that evaluation.
    """
    gate = (
        ~F.col("status").isin(*policy.excluded_statuses)
        & ~F.col("disposition_tag").isin(*policy.excluded_tags)
        & ~F.col("quality_state").isin(*policy.excluded_quality)
    )
    types = values(
        contributors.sparkSession, ["analytical_type", "family", "role"],
        [(t, f, "SUPPORTING") for t, f in policy.families.items()] + [(t, t, "CONTRADICTING") for t in policy.contradicting],
    )
    length = days_us(policy.window_days)
    slot = -floor_div(-micros("effective_at"), F.lit(length).cast("bigint"))
    return (
        contributors.filter(gate).join(types, "analytical_type")
        .withColumn("as_of", F.timestamp_micros(slot * length).cast("timestamp_ntz"))
        .withColumn("hypothesis_type", F.lit(policy.hypothesis_type))
    )


def independent_counts(supporting: DataFrame, keys: list[str]) -> DataFrame:
    """Independent contributors per hypothesis after shared family and shared lineage are merged.

    Contributors of one family are always one; two families are one when any of their contributors
    share a lineage group. So the merge runs over families, of which a policy names a handful, and
    never over the contributors themselves.
    """
    families = supporting.groupBy(*keys).agg(F.collect_set("family").alias("_families"), F.count(F.lit(1)).alias("raw_supporting"))
    linked = (
        supporting.filter("lineage_group IS NOT NULL").groupBy(*keys, "lineage_group").agg(F.sort_array(F.collect_set("family")).alias("_together"))
        .filter(F.size("_together") > 1)
        .groupBy(*keys).agg(F.collect_set("_together").alias("_links"))
    )
    start = F.transform("_families", lambda f: F.array(f))

    def merge(groups: Column, link: Column) -> Column:
        touched = F.filter(groups, lambda g: F.arrays_overlap(g, link))
        rest = F.filter(groups, lambda g: ~F.arrays_overlap(g, link))
        return F.concat(rest, F.array(F.array_distinct(F.flatten(touched))))

    collapsed = F.aggregate(F.coalesce("_links", F.array().cast("array<array<string>>")), start, merge)
    return families.join(linked, keys, "left").select(
        *keys, "raw_supporting", F.size("_families").alias("families"), F.size(collapsed).alias("independent_supporting")
    )


def confidence(policy: CorrelationPolicy, lowest: Column, mean: Column, independent: Column) -> Column:
    """Confidence of the supporting contributors by the policy's method.

    BOUNDED_RULE has no public formula. Ours: the mean, raised by 0.05 per independent family above the
    minimum and kept within [lowest, 0.95].
    """
    if policy.confidence_method == "MINIMUM_CONTRIBUTOR_CONFIDENCE":
        return lowest
    if policy.confidence_method == "WEIGHTED_CONTRIBUTORS":
        return mean
    return F.greatest(lowest, F.least(mean + (independent - policy.minimum_families) * 0.05, F.lit(0.95)))


def hypotheses(contributors: DataFrame, policy: CorrelationPolicy) -> DataFrame:
    """PROPOSED hypotheses with enough independent supporting families."""
    cand = candidates(contributors, policy)
    support = cand.filter("role = 'SUPPORTING'")
    conf = F.col("confidence").cast("double")
    stats = cand.groupBy(*HYPOTHESIS).agg(
        F.sum(F.when(F.col("role") == "SUPPORTING", F.col("confidence"))).cast("double").alias("_sum"),
        F.count(F.when(F.col("role") == "SUPPORTING", 1)).alias("_n"),
        F.min(F.when(F.col("role") == "SUPPORTING", conf)).alias("_low"),
        F.count(F.when(F.col("role") == "CONTRADICTING", 1)).alias("contradicting"),
        F.min("effective_at").alias("window_first"), F.max("effective_at").alias("window_last"),
    )
    out = independent_counts(support, HYPOTHESIS).join(stats, HYPOTHESIS)
    base = confidence(policy, F.col("_low"), F.col("_sum") / F.col("_n"), F.col("independent_supporting"))
    against = F.col("contradicting") > 0
    reduced = F.when(against & F.lit(policy.contradiction_mode == "REDUCE_CONFIDENCE"), base * 0.8).otherwise(base)
    return out.filter(F.col("independent_supporting") >= policy.minimum_families).select(
        *HYPOTHESIS, "raw_supporting", "families", "independent_supporting", "contradicting", "window_first", "window_last",
        F.round(reduced, 6).alias("confidence"), F.lit(policy.materiality).alias("materiality"),
        F.lit("PROPOSED").alias("status"),
        (against & F.lit(policy.contradiction_mode == "BLOCK_ACTIVATION")).alias("activation_blocked"),
        F.lit(True).alias("requires_human_validation"),
    )


def lifecycle(found: DataFrame, window_days: int) -> DataFrame:
    """PROPOSED in the first window of a run, ACTIVE while it lasts, RESOLVED in the window after it.

    There is one row per counterparty and window, so the window over a counterparty is bounded by
    the calendar.
    """
    w = Window.partitionBy("hypothesis_type", "counterparty_id").orderBy("as_of")
    step = days_us(window_days)
    before, after = F.lag("as_of").over(w), F.lead("as_of").over(w)
    rows = found.select("hypothesis_type", "counterparty_id", "as_of", before.alias("_b"), after.alias("_a"))
    follows = F.coalesce(micros("as_of") - micros("_b") == step, F.lit(False))
    ends = F.coalesce(micros("_a") - micros("as_of") > step, F.lit(True))
    state = rows.withColumn("status", F.when(follows, "ACTIVE").otherwise("PROPOSED")).withColumn("_ends", ends)
    gone = state.filter("_ends").select(
        "hypothesis_type", "counterparty_id", (F.col("as_of") + F.expr(f"INTERVAL {window_days} DAYS")).alias("as_of"),
        F.lit("RESOLVED").alias("status"),
    )
    return state.select("hypothesis_type", "counterparty_id", "as_of", "status").unionByName(gone)
