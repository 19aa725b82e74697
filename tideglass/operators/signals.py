"""Proposed signals: coded detections, templates, dispositions and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import (
    classify_dpd, dpd_materiality, dpd_severity, name_uuid,
)
from tideglass.operators.ordered import sessions, with_previous

SIGNAL_COLUMNS = [
    "signal_id", "signal_type", "semantic_scope", "entity_type", "entity_id", "status", "severity", "confidence_value",
    "materiality_band", "effective_at", "knowledge_time", "policy_id", "policy_version", "data_quality_state",
    "evidence_ids",
]

# Policy ids, versions and thresholds of the coded signals.
PAYMENT_POLICY = ("POL-PAYMENT-RETURN-CORP-001", "2.0")
DPD_POLICIES = {"DPD_EMERGED": "POL-DPD-EMERGED-CORP-001", "DPD_WORSENING": "POL-DPD-WORSENING-CORP-001"}
DPD_POLICY_VERSION = "1.0"
PAYMENT_RETURN_THRESHOLD = 3
DECISION_STATUS = {
    "ACCEPT": "ACCEPTED", "REJECT": "REJECTED", "MARK_DUPLICATE": "REJECTED", "MARK_FALSE_POSITIVE": "REJECTED",
    "REQUEST_EVIDENCE": "PROPOSED", "DEFER": "PROPOSED",
}
SIGNAL_TRANSITIONS = [
    ("DETECTED", "PROPOSED"), ("PROPOSED", "ACCEPTED"), ("PROPOSED", "REJECTED"), ("ACCEPTED", "ACTIVE"),
    ("ACTIVE", "MITIGATED"), ("ACTIVE", "CLOSED"), ("ACTIVE", "EXPIRED"), ("ACTIVE", "SUPERSEDED"),
]


def project_signal(
    features: DataFrame, signal_type: Column, signal_id: Column, severity: Column, confidence: float,
    materiality: Column, policy_id: Column, policy_version: str,
) -> DataFrame:
    """Feature rows -> signal rows in status PROPOSED; the feature value is the evidence."""
    return features.select(
        signal_id.alias("signal_id"),
        signal_type.alias("signal_type"),
        F.lit("GLOBAL_CORE").alias("semantic_scope"),
        "entity_type", "entity_id",
        F.lit("PROPOSED").alias("status"),
        severity.alias("severity"),
        F.lit(confidence).alias("confidence_value"),
        materiality.alias("materiality_band"),
        F.col("window_end").alias("effective_at"),
        "knowledge_time",
        policy_id.alias("policy_id"),
        F.lit(policy_version).alias("policy_version"),
        F.coalesce("quality_state", F.lit("COMPLETE")).alias("data_quality_state"),
        F.array("feature_value_id").alias("evidence_ids"),
    )


def repeated_payment_return(features: DataFrame, threshold: int = PAYMENT_RETURN_THRESHOLD) -> DataFrame:
    hit = features.filter((F.col("feature_name") == "returned_payment_count_30d") & (F.col("value_numeric") >= threshold))
    return project_signal(
        hit, F.lit("REPEATED_PAYMENT_RETURN"), name_uuid(F.col("feature_value_id")), F.lit("MEDIUM"), 0.8,
        F.lit("MEDIUM"), F.lit(PAYMENT_POLICY[0]), PAYMENT_POLICY[1],
    )


def trackable_dpd(features: DataFrame) -> DataFrame:
    return features.filter(
        (F.col("feature_name") == "current_dpd") & F.col("state").isin("VALUE", "ZERO") & F.col("value_numeric").isNotNull()
    )


def dpd_crossings(features: DataFrame) -> DataFrame:
    """Trackable DPD rows with the previous accepted value and the crossing they make, if any."""
    rows = trackable_dpd(features).withColumn("dpd", F.col("value_numeric").cast("int"))
    rows = with_previous(rows, ["entity_id"], "window_end", ["feature_value_id"], {"_prev": "dpd"})
    previous = F.coalesce(F.col("_prev"), F.col("prior_value_numeric").cast("int"))
    return rows.withColumn("previous_dpd", previous).withColumn("crossing", classify_dpd(previous, F.col("dpd"))).drop("_prev")


def dpd_signals(features: DataFrame) -> DataFrame:
    hit = dpd_crossings(features).filter(F.col("crossing").isNotNull())
    kind = F.col("crossing")
    policy = F.when(kind == "DPD_WORSENING", DPD_POLICIES["DPD_WORSENING"]).otherwise(DPD_POLICIES["DPD_EMERGED"])
    return project_signal(
        hit, kind, name_uuid(F.concat_ws(":", kind, "feature_value_id")), dpd_severity(F.col("dpd")), 0.9,
        dpd_materiality(F.col("dpd")), policy, DPD_POLICY_VERSION,
    )


def with_evidence(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals that cite evidence, signals that cite none and are rejected)."""
    has = F.coalesce(F.size("evidence_ids") >= 1, F.lit(False))
    return signals.filter(has), signals.filter(~has)


def evidence_drilldown(signals: DataFrame, features: DataFrame, status: str | None = "PROPOSED") -> DataFrame:
    """Signals with the feature rows they cite, one row per (signal, known evidence).

    Ids without a feature row are skipped; a signal left without evidence keeps one row of nulls.
    """
    chosen = signals if status is None else signals.filter(F.col("status") == status)
    refs = chosen.select("signal_id", F.explode("evidence_ids").alias("evidence_id"))
    facts = features.select(
        F.col("feature_value_id").alias("evidence_id"), "feature_name", F.col("state").alias("evidence_state"),
        F.col("value_numeric").alias("evidence_value"), "window_start", "window_end",
    )
    return chosen.join(refs.join(facts, "evidence_id"), "signal_id", "left")


def apply_dispositions(signals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First decision per PROPOSED signal wins; every further decision is a conflict.

    ``decisions`` has signal_id, decision, decided_at, decision_no.
    """
    mapping = F.create_map(*[F.lit(x) for pair in DECISION_STATUS.items() for x in pair])
    first = decisions.groupBy("signal_id").agg(
        F.min_by(F.struct("decision", "decided_at", "decision_no"), F.struct("decided_at", "decision_no")).alias("_d")
    )
    proposed = F.col("status") == "PROPOSED"
    applied = signals.join(first, "signal_id", "left").withColumn(
        "status", F.when(proposed & F.col("_d").isNotNull(), F.element_at(mapping, F.col("_d.decision"))).otherwise(F.col("status"))
    ).withColumn("decided_at", F.col("_d.decided_at")).drop("_d")
    conflicts = (
        decisions.join(first, "signal_id")
        .join(signals.select("signal_id", F.col("status").alias("_was")), "signal_id", "left")
        .filter(
            F.col("_was").isNull() | (F.col("_was") != "PROPOSED") | (F.col("decision_no") != F.col("_d.decision_no"))
        )
        .select(
            "signal_id", "decision_no", "decision",
            F.when(F.col("_was").isNull(), "UNKNOWN_SIGNAL").when(F.col("_was") != "PROPOSED", "NOT_PROPOSED")
            .otherwise("ALREADY_DECIDED").alias("conflict"),
        )
    )
    return applied, conflicts


def lifecycle_violations(history: DataFrame, keys: list[str], ts: str, ties: list[str], allowed: list[tuple[str, str]]) -> DataFrame:
    """Status changes that the allowed pairs do not contain."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    moved = with_previous(history, keys, ts, ties, {"previous_status": "status"})
    return moved.filter(
        F.col("previous_status").isNotNull()
        & ~F.array_contains(pairs, F.concat_ws(">", "previous_status", "status"))
    )


def suppress_repeats(signals: DataFrame, keys: list[str], ts: str, gap_days: float) -> DataFrame:
    """Keep the first signal of every run of detections no more than ``gap_days`` apart."""
    tagged, _ = sessions(signals, keys, ts, gap_days, [F.count(F.lit(1)).alias("n")])
    return tagged.withColumn("kept", F.col(ts) == F.col("session_start"))


def decay(points: Column, age: Column, half_life_days: float) -> Column:
    return points * F.pow(F.lit(0.5), age / F.lit(half_life_days))
