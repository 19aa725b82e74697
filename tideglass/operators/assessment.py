"""Proposed risk assessments: contributions, substitution, dimension and overall scores, review."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import BANDS, from_rank, ladder, rank_in
from tideglass.sources.reference import values


@dataclass(frozen=True)
class AggregationPolicy:
    points: dict[str, float]
    bands: tuple[tuple[float, str], ...]
    caps: dict[str, float]
    substitution: tuple[tuple[str, str, float, tuple[str, ...]], ...]
    minimum_confidence: float = 0.5
    review_band: str = "HIGH"
    review_on_contradiction: bool = True
    weights: dict[str, float] = field(default_factory=dict)


# The reference aggregation policy.
CORPORATE = AggregationPolicy(
    points={"INFO": 0, "LOW": 20, "MEDIUM": 40, "HIGH": 70, "CRITICAL": 90},
    bands=((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"), (0, "LOW")),
    caps={"LIQUIDITY": 100, "REPAYMENT_CONDUCT": 100, "CASH_FLOW_DEBT_SERVICE": 100, "REFINANCING_FUNDING": 100},
    substitution=(("EMERGING_LIQUIDITY_STRESS", "LIQUIDITY", 80, ("UTILIZATION_PRESSURE", "PAYMENT_RETURN", "DELINQUENCY")),),
)
# Risk dimensions of each signal, as in the outcomes of its rule policy.
SIGNAL_DIMENSIONS = [
    ("REPEATED_PAYMENT_RETURN", "REPAYMENT_CONDUCT"), ("REPEATED_PAYMENT_RETURN", "LIQUIDITY"),
    ("DPD_DERIORATION", "REPAYMENT_CONDUCT"), ("DPD_DERIORATION", "CASH_FLOW_DEBT_SERVICE"),
    ("DPD_EMERGED", "REPAYMENT_CONDUCT"), ("DPD_EMERGED", "CASH_FLOW_DEBT_SERVICE"),
    ("DPD_WORSENING", "REPAYMENT_CONDUCT"), ("DPD_WORSENING", "CASH_FLOW_DEBT_SERVICE"),
    ("UTILIZATION_HIGH", "LIQUIDITY"), ("UTILIZATION_HIGH", "REFINANCING_FUNDING"),
    ("UTILIZATION_SPIKE", "LIQUIDITY"), ("UTILIZATION_SPIKE", "REFINANCING_FUNDING"),
]

GROUP = ["counterparty_id", "as_of"]


def band_for_score(score: Column, policy: AggregationPolicy) -> Column:
    """Highest band whose minimum the score reaches."""
    (low, name) = policy.bands[-1]
    return F.when(score >= low, ladder(score, list(policy.bands[:-1]) + [(low, name)], name))


def contributions(candidates: DataFrame, policy: AggregationPolicy) -> tuple[DataFrame, DataFrame]:
    """(points per contributor and risk dimension, contributors the quality gate leaves out)."""
    ok = F.col("confidence") >= policy.minimum_confidence
    dims = values(candidates.sparkSession, ["analytical_type", "risk_dimension"], SIGNAL_DIMENSIONS)
    mapping = F.create_map(*[F.lit(x) for k, v in policy.points.items() for x in (k, float(v))])
    kept = candidates.filter(ok).join(dims, "analytical_type").withColumn("points", F.element_at(mapping, F.col("severity")))
    return kept, candidates.filter(~ok)


def substitute(points: DataFrame, found: DataFrame, policy: AggregationPolicy) -> DataFrame:
    """Score rows per (counterparty, as_of, dimension) with a role.

    A hypothesis scores in its dimension instead of the families it stands for; those keep role
    LINEAGE_ONLY there and still score in other dimensions. Contributors are first reduced to
    one row per family and dimension, as only their maximum counts.
    """
    spark = points.sparkSession
    reduced = points.groupBy(*GROUP, "risk_dimension", "family").agg(F.max("points").alias("points"), F.count(F.lit(1)).alias("contributors"))
    rules = values(
        spark, ["hypothesis_type", "risk_dimension", "points", "suppressed"],
        [(h, d, float(p), ",".join(f)) for h, d, p, f in policy.substitution],
    )
    scoring = found.select("hypothesis_type", *GROUP).join(rules, "hypothesis_type")
    hush = scoring.select(*GROUP, "risk_dimension", F.explode(F.split("suppressed", ",")).alias("family"), F.lit(True).alias("_hush")).distinct()
    signals = reduced.join(hush, [*GROUP, "risk_dimension", "family"], "left").select(
        *GROUP, "risk_dimension", F.lit("SIGNAL").alias("source"), "family", F.col("points").cast("double").alias("points"), "contributors",
        F.when(F.col("_hush"), "LINEAGE_ONLY").otherwise("SCORING").alias("role"),
    )
    return signals.unionByName(
        scoring.select(
            *GROUP, "risk_dimension", F.lit("CORRELATION_HYPOTHESIS").alias("source"), F.col("hypothesis_type").alias("family"),
            F.col("points").cast("double").alias("points"), F.lit(1).cast("bigint").alias("contributors"), F.lit("SCORING").alias("role"),
        )
    )


def dimension_scores(scored: DataFrame, policy: AggregationPolicy) -> DataFrame:
    """Largest scoring contribution per dimension, capped, with its band."""
    caps = F.create_map(*[F.lit(x) for k, v in policy.caps.items() for x in (k, float(v))])
    cap = F.try_element_at(caps, F.col("risk_dimension"))
    raw = scored.groupBy(*GROUP, "risk_dimension").agg(F.max(F.when(F.col("role") == "SCORING", F.col("points"))).alias("_raw"))
    score = F.least("_raw", cap)
    return raw.filter("_raw IS NOT NULL").select(
        *GROUP, "risk_dimension", score.alias("raw_score"), F.coalesce(F.col("_raw") > cap, F.lit(False)).alias("cap_applied"),
        band_for_score(score, policy).alias("proposed_band"),
    )


def overall_max(dims: DataFrame) -> DataFrame:
    """The highest dimension and its band; the first dimension by name wins a tie."""
    best = dims.groupBy(*GROUP, "raw_score").agg(
        F.min(F.struct("risk_dimension", "proposed_band")).alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    return best.groupBy(*GROUP).agg(
        F.max("raw_score").alias("raw_score"), F.max_by("_d", "raw_score").alias("_d"), F.sum("_n").alias("dimensions")
    ).select(
        *GROUP, "raw_score", F.col("_d.proposed_band").alias("proposed_band"), "dimensions",
        F.col("_d.risk_dimension").alias("leading_dimension"),
    )


def overall_weighted(dims: DataFrame, weights: dict[str, float], policy: AggregationPolicy) -> DataFrame:
    """Sum of weight x score; weights must add up to 1."""
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("dimension weights must sum to 1")
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    total = F.sum(F.coalesce(F.try_element_at(w, F.col("risk_dimension")), F.lit(0.0)) * F.col("raw_score"))
    out = dims.groupBy(*GROUP).agg(F.round(total, 6).alias("raw_score"))
    return out.withColumn("proposed_band", band_for_score(F.col("raw_score"), policy))


def overall_band_only(dims: DataFrame) -> DataFrame:
    worst = F.max(rank_in(F.col("proposed_band"), BANDS))
    return dims.groupBy(*GROUP).agg(worst.alias("_r")).withColumn("proposed_band", from_rank(F.col("_r"), BANDS)).drop("_r")


def human_review(overall: DataFrame, contradictions: DataFrame, policy: AggregationPolicy) -> DataFrame:
    """Review from the policy's band upward, or when a contradiction is present."""
    against = contradictions.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("contradictions"))
    severe = rank_in(F.col("proposed_band"), BANDS) >= BANDS.index(policy.review_band)
    clash = F.coalesce(F.col("contradictions") > 0, F.lit(False)) & F.lit(policy.review_on_contradiction)
    return overall.join(against, GROUP, "left").withColumn("requires_human_review", severe | clash).withColumn(
        "contradictions", F.coalesce("contradictions", F.lit(0))
    )
