"""Episodes: continuity of one condition over repeated signals.

Members, revisions and evidence stay rows of their own tables; an episode of a busy entity is never
folded into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import SEVERITIES, from_rank, micros, name_uuid, rank_in
from tideglass.operators.ordered import running, sessions, with_previous

# Permitted status changes.
EPISODE_TRANSITIONS = [
    ("OPEN", "OPEN"), ("OPEN", "MONITORING"), ("OPEN", "RESOLVED"), ("OPEN", "SUPERSEDED"),
    ("MONITORING", "MONITORING"), ("MONITORING", "OPEN"), ("MONITORING", "RESOLVED"), ("MONITORING", "SUPERSEDED"),
    ("RESOLVED", "OPEN"),
]
HYPOTHESIS_TRANSITIONS = [
    ("PROPOSED", "PROPOSED"), ("PROPOSED", "ACTIVE"), ("PROPOSED", "REJECTED"), ("PROPOSED", "RESOLVED"),
    ("ACTIVE", "ACTIVE"), ("ACTIVE", "RESOLVED"),
]


def episode_key(mode: Column, policy_id: Column, version: Column, entity_type: Column, entity_id: Column, signal_type: Column, discriminator: Column) -> Column:
    parts = [mode, policy_id, version, entity_type, entity_id, signal_type, discriminator]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def keyed(signals: DataFrame, mode: str = "LIVE") -> DataFrame:
    return signals.withColumn(
        "episode_key",
        episode_key(
            F.lit(mode), F.concat(F.lit("EP-"), F.col("policy_id")), F.lit("1"), F.col("entity_type"), F.col("entity_id"),
            F.col("signal_type"), F.col("entity_id"),
        ),
    )


def _episode_id() -> Column:
    return name_uuid(F.concat_ws("|", "episode_key", F.unix_micros(F.col("session_start").cast("timestamp")).cast("string")))


def build(signals: DataFrame, inactivity_days: float) -> tuple[DataFrame, DataFrame]:
    """(episodes, members). A detection later than the inactivity gap opens a new episode."""
    rank = rank_in(F.col("severity"), SEVERITIES)
    order = F.struct("effective_at", "signal_id")
    tagged, grouped = sessions(
        keyed(signals), ["episode_key"], "effective_at", inactivity_days,
        [
            F.max("effective_at").alias("last_activity_at"), F.count(F.lit(1)).alias("occurrences"),
            F.max(rank).alias("_peak"), F.max_by("severity", order).alias("current_severity"),
            F.min_by("signal_id", order).alias("primary_signal"), F.first("signal_type").alias("signal_type"),
            F.first("entity_id").alias("entity_id"),
        ],
    )
    episodes = grouped.select(
        _episode_id().alias("episode_id"), "episode_key", "signal_type", "entity_id", F.col("session_start").alias("opened_at"),
        "last_activity_at", "occurrences", from_rank(F.col("_peak"), SEVERITIES).alias("peak_severity"), "current_severity",
        "primary_signal",
    )
    first = grouped.select("episode_key", "session_start", "primary_signal")
    members = tagged.join(first, ["episode_key", "session_start"]).select(
        _episode_id().alias("episode_id"), "signal_id", "effective_at", "evidence_ids",
        F.when(F.col("signal_id") == F.col("primary_signal"), "PRIMARY").otherwise("SUPPORTING").alias("role"),
    )
    return episodes, members


def evidence_of(members: DataFrame, group: str) -> DataFrame:
    """Distinct evidence of all members, one row each."""
    return members.select(group, F.explode("evidence_ids").alias("evidence_id")).distinct()


def lifecycle(signals: DataFrame, inactivity_days: float, as_of: Column) -> DataFrame:
    """Revisions of the condition of each key.

    A first detection opens; a detection after a gap reopens; a higher severity keeps it open; any
    other is monitoring. A gap longer than the inactivity resolves it at the end of the gap.
    """
    rows = keyed(signals).withColumn("_rank", rank_in(F.col("severity"), SEVERITIES))
    rows = with_previous(rows, ["episode_key"], "effective_at", ["signal_id"], {"_at": "effective_at", "_was": "_rank"})
    gap = F.lit(int(inactivity_days * 86_400_000_000))
    fresh, late = F.col("_at").isNull(), micros("effective_at") - micros("_at") > gap
    detected = rows.select(
        "episode_key", F.col("effective_at").alias("changed_at"), "signal_id", "severity",
        F.when(fresh, "OPENED").when(late, "REOPENED").when(F.col("_rank") > F.col("_was"), "ESCALATED").otherwise("UPDATED").alias("transition"),
    )
    last = rows.groupBy("episode_key").agg(F.max_by(F.struct("signal_id", "severity", "effective_at"), F.struct("effective_at", "signal_id")).alias("_l"))
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(inactivity_days * 86400))
    ended = rows.filter(late).select(
        "episode_key", (F.col("_at") + interval).alias("changed_at"), F.lit("").alias("signal_id"), "severity"
    ).unionByName(
        last.select("episode_key", (F.col("_l.effective_at") + interval).alias("changed_at"), F.lit("").alias("signal_id"), F.col("_l.severity").alias("severity"))
        .filter(F.col("changed_at") <= as_of)
    ).withColumn("transition", F.lit("RESOLVED"))
    status = (
        F.when(F.col("transition").isin("OPENED", "REOPENED", "ESCALATED"), "OPEN").when(F.col("transition") == "RESOLVED", "RESOLVED").otherwise("MONITORING")
    )
    revisions = detected.unionByName(ended).withColumn("status", status)
    return running(
        revisions, ["episode_key"], "changed_at", ["signal_id"],
        {"revision": ("count", F.lit(1)), "reopen_count": ("count", F.when(F.col("transition") == "REOPENED", 1))},
    )


def analyst_updates(revisions: DataFrame) -> DataFrame:
    """Only what an analyst needs to see: opening, reopening, escalation and resolution."""
    return revisions.filter(F.col("transition") != "UPDATED")
